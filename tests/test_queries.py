"""Registered queries against their SQL on the provided tables.

The default run takes some queries of every area; ``ALL_QUERIES=1`` takes all.
"""

import os

import pytest
from compare import difference

from retailscope.plans.catalogue import all_queries

SOME = """
store_overview sort_stores_page shared_inboxes normalise_store_feed next_feed_cursor theme_staleness run_report
check_transitions apply_status_changes parse_speed_reports upsert_mixed_policy append_versioned_letters
grade_page_seo grade_technical merge_duplicate_issues classify_bot_walls extract_page_text extract_links apply_robots
select_links save_contacts drop_suppressed union_candidates lead_score select_images build_context store_detail
nearest_earlier_text check_letters stream_run_report
""".split()
QUERIES = all_queries()
CHOSEN = [n for n in QUERIES if QUERIES[n].sql is not None and (os.environ.get("ALL_QUERIES") or n in SOME)]


def test_chosen_names_exist():
    assert set(SOME) <= set(QUERIES)


@pytest.mark.parametrize("name", CHOSEN)
def test_matches_sql(name, spark, duck, sf_dir):
    got = QUERIES[name].build(spark, sf_dir).toPandas()
    want = duck.execute(QUERIES[name].sql).df()
    assert difference(got, want) is None


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(3).count() == 3
    assert set(e.oracle_sql()) <= set(e.queries())
