"""Issues as a set: union, merging of duplicates, order, audit outcome."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retailscope.functions.ranks import SEVERITIES, page_rank, severity_rank
from retailscope.operators.grading import EVIDENCE_TYPE, MAX_EVIDENCE, SLOW_LOAD_MS, Rule, escalate, evidence, grade, say
from retailscope.operators.keyed import first_per_key, number_rows

# What is no finding.
IGNORED_CONSOLE = "(?i)^Failed to load resource|favicon|\\[GSI_LOGGER\\]"
ABORTED = "net::ERR_ABORTED"
PLATFORM_NOISE = "/sf_private_access_tokens\\b|/\\.well-known/shopify/monorail"
# Resource types a page cannot do without.
BLOCKING = ("script", "stylesheet", "font", "fetch", "xhr")
# Statuses servers answer robots with.
BOT_STATUSES = (401, 403, 405, 406, 429, 999)


def union_findings(*frames: DataFrame) -> DataFrame:
    """Issues of several graders in one frame, numbered by grader."""
    numbered = [f.withColumn("grader_no", F.lit(i)) for i, f in enumerate(frames)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)


def merge_duplicate_issues(issues: DataFrame, keys: Sequence[str] = ("audit_id", "page", "category", "title"), order: str = "id") -> DataFrame:
    """One issue per key: worst severity, first detail, distinct evidence.

    Evidence is made distinct and cut to its first ten before it is gathered,
    so no list grows with the number of copies.
    """
    cols = list(keys)
    worst = F.min(severity_rank(F.col("severity")))
    has_detail = F.when(F.col("detail").isNotNull() & (F.col("detail") != ""), F.col(order))
    heads = issues.groupBy(*cols).agg(
        F.try_element_at(F.array(*map(F.lit, SEVERITIES)), worst + 1).alias("severity"),
        F.min_by("detail", has_detail).alias("detail"),
        F.min(order).alias(order),
        F.count(F.lit(1)).alias("merged"),
    )
    records = issues.select(*cols, F.col(order).alias("_order"), F.posexplode("evidence").alias("_pos", "record"))
    seen = records.groupBy(*cols, "record").agg(F.min(F.struct("_order", "_pos")).alias("_first"))
    kept = first_per_key(seen, cols, [F.col("_first")], MAX_EVIDENCE)
    gathered = kept.groupBy(*cols).agg(F.array_sort(F.collect_list(F.struct("_first", "record"))).alias("_list"))
    joined = heads.join(gathered.select(*cols, F.col("_list")["record"].alias("evidence")), cols, "left")
    return joined.withColumn("evidence", F.coalesce("evidence", F.array().cast(f"array<{EVIDENCE_TYPE}>")))


def worst_order(tie: str) -> list[Column]:
    """Reading order: severity, page of the funnel, then title or id."""
    return [severity_rank(F.col("severity")), page_rank(F.col("page")), F.col(tie)]


def worst_first(issues: DataFrame, tie: str = "title") -> DataFrame:
    return issues.orderBy(*worst_order(tie))


def number_worst_first(issues: DataFrame, keys: Sequence[str], tie: str = "id", name: str = "position") -> DataFrame:
    """Every issue with its place in the reading order of its key."""
    severity, page, _ = worst_order(tie)
    return number_rows(issues, keys, worst_order(tie), severity * 100 + page, name)


def drop_noise(observations: DataFrame) -> DataFrame:
    """Console messages, failed requests and HTTP errors worth keeping."""
    where = F.col("list")
    console = (where == "console") & (F.coalesce(F.col("kind"), F.lit("console")) == "console")
    noise = (
        (console & F.coalesce(F.col("text").rlike(IGNORED_CONSOLE), F.lit(False)))
        | ((where == "failed") & F.coalesce(F.col("error_text") == ABORTED, F.lit(False)))
        | ((where == "http") & F.coalesce(F.col("status") < 400, F.lit(True)))
    )
    return observations.filter(~noise)


def tally_observations(observations: DataFrame, max_keys: int | None = None) -> DataFrame:
    """Distinct observations per page and list with their count, numbered as first seen.

    All are kept. With ``max_keys`` only the first of each list are, as with an
    observer that stops recording new ones; ``truncated`` says that a page had more.
    """
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    key = (
        F.when((F.col("list") == "console") & (F.col("kind") == "exception"), F.concat_ws("|", F.lit("exception"), text("text")))
        .when(F.col("list") == "console", F.concat_ws("|", F.lit("console"), text("text"), text("url"), text("line")))
        .when(F.col("list") == "failed", F.concat_ws("|", text("url"), text("error_text")))
        .otherwise(F.concat_ws("|", text("url"), text("status")))
    )
    fields = [c for c in ("kind", "text", "url", "line", "error_text", "status", "resource_type", "method") if c in observations.columns]
    counted = (
        observations.withColumn("_key", key)
        .groupBy("page_id", "list", "_key")
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.min("seq").alias("first_seq"),
            F.min_by(F.struct(*fields), "seq").alias("_first"),
        )
    )
    columns = ["page_id", "list", "key_no", "count", "first_seq", "truncated", "_first.*"]
    if max_keys is None:
        numbered = number_rows(counted, ["page_id", "list"], [F.col("first_seq"), F.col("_key")], name="key_no")
        return numbered.withColumn("truncated", F.lit(False)).select(*columns)
    more = counted.groupBy("page_id", "list").agg((F.count(F.lit(1)) > max_keys).alias("_more"))
    truncated = more.groupBy("page_id").agg(F.bool_or("_more").alias("truncated"))
    kept = first_per_key(counted, ["page_id", "list"], [F.col("first_seq"), F.col("_key")], max_keys, rank="key_no")
    return kept.join(truncated, "page_id").select(*columns)


def _top_evidence(rows: DataFrame, group: Sequence[str], order: Column, record: Column) -> DataFrame:
    """How many rows a group has, and evidence from its first ten."""
    counts = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    first = first_per_key(rows.withColumn("_order", order), group, [F.col("_order")], MAX_EVIDENCE)
    lists = first.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(F.col("_order"), record.alias("r")))).alias("_l"))
    return counts.join(lists.select(*group, F.col("_l")["r"].alias("evidence")), list(group))


def grade_technical(pages: DataFrame, tallied: DataFrame, broken_images: DataFrame | None = None, slow_ms: int = SLOW_LOAD_MS) -> DataFrame:
    """Script errors, failed resources, broken images and slow loading.

    ``pages``: page_id, audit_id, store_id, page, url, viewport, navigation_ms.
    """
    c = F.col
    seen = tallied.join(pages.select("page_id", c("url").alias("_page_url")), "page_id")
    fault = F.when(c("list") == "console", F.when(c("kind") == "exception", F.lit("exception")).otherwise(F.lit("logged"))).otherwise(
        F.when(
            c("resource_type").isin(*BLOCKING), F.when(~c("url").rlike(PLATFORM_NOISE), F.lit("blocking"))
        ).otherwise(F.lit("other"))
    )
    own_page = (c("list") == "http") & (c("url") == c("_page_url"))
    sorted_out = seen.filter(~F.coalesce(own_page, F.lit(False))).withColumn("fault", fault).filter(c("fault").isNotNull())
    is_console = c("list") == "console"
    record = evidence(
        url=F.when(is_console, F.coalesce(F.when(c("kind") == "console", c("url")), c("_page_url"))).otherwise(c("url")),
        text=F.when(is_console, c("text")).when(c("list") == "failed", c("error_text")),
        status=F.when(c("list") == "http", c("status")),
        actual=F.when(is_console, F.when(c("line") > 0, say("line ", c("line")))).otherwise(c("resource_type")),
        count=F.when(is_console & (c("count") > 1), c("count")),
    )
    order = F.struct(F.when(c("list") == "http", 0).otherwise(1), c("first_seq"), c("key_no"))
    faults = _top_evidence(sorted_out, ["page_id", "fault"], order, record)
    if broken_images is not None:
        located = broken_images.join(pages.select("page_id", "viewport"), "page_id").withColumn("fault", F.lit("image"))
        shown = evidence(selector=c("selector"), url=c("src"), viewport=c("viewport"), text=F.when(c("alt") != "", c("alt")))
        faults = faults.unionByName(_top_evidence(located, ["page_id", "fault"], F.struct("pos"), shown))
    rows = faults.join(pages, "page_id")
    raised = lambda base: escalate(F.lit(base), c("page"))
    is_fault = lambda name: c("fault") == name
    rules = [
        Rule(is_fault("exception"), "technical", raised("MAJOR"), "JavaScript errors break the page", say(c("n"), " uncaught error(s) while loading the page"), c("evidence")),
        Rule(is_fault("logged"), "technical", raised("MINOR"), "Scripts log errors to the console", say(c("n"), " console error(s)"), c("evidence")),
        Rule(is_fault("blocking"), "technical", raised("MAJOR"), "Scripts or styles fail to load", say(c("n"), " blocking resource(s) did not load"), c("evidence")),
        Rule(is_fault("other"), "technical", "MINOR", "Some resources return errors", say(c("n"), " resource(s) failed"), c("evidence")),
        Rule(is_fault("image"), "ux", "MAJOR", "Images do not display", say(c("n"), " image(s) fail to render"), c("evidence")),
    ]
    keys = ["page_id", "audit_id", "store_id"]
    # one place, nearest to the binary value, exact halves up
    nudged = F.when(c("navigation_ms") % 500 == 250, c("navigation_ms") + 1).otherwise(c("navigation_ms"))
    took = F.concat(F.expr("format_number(_seconds, '0.0')"), F.lit("s"))
    slow = [
        Rule(c("navigation_ms") >= slow_ms, "performance", "MAJOR", "Page takes too long to open", F.concat(F.lit("The page needed "), took, F.lit(" to become interactive")), {"expected": f"< {slow_ms // 1000}s", "actual": took}),
    ]
    timed = pages.withColumn("_seconds", nudged / 1000)
    return grade(rows, rules, c("page"), keys).unionByName(grade(timed, slow, c("page"), keys))


def broken_links(probes: DataFrame) -> DataFrame:
    """Probes whose link leads nowhere.

    Statuses servers give robots do not count, nor do server errors of other
    sites; a probe without a status failed in transport and counts.
    """
    status = F.col("status")
    broken = status.isNull() | (
        (status >= 400) & ~status.isin(*BOT_STATUSES) & (F.col("internal") | (status < 500))
    )
    return probes.filter(broken)


def grade_links(probes: DataFrame, keys: Sequence[str] = ("audit_id", "store_id", "page")) -> DataFrame:
    """Broken internal links, and links to pages elsewhere that are gone."""
    c = F.col
    group = [*keys, "internal"]
    checked = probes.groupBy(*keys).agg(F.count(F.lit(1)).alias("checked"))
    record = evidence(
        url=c("url"),
        text=F.when(c("status").isNull(), F.coalesce("error", F.lit("no response"))),
        status=c("status"),
        selector=F.when(c("internal") & (c("text") != ""), F.concat(F.lit('a "'), c("text"), F.lit('"'))),
    )
    rows = _top_evidence(broken_links(probes), group, F.struct("pos"), record).join(checked, list(keys))
    rules = [
        Rule(c("internal"), "technical", "MAJOR", "Broken links on the site", say(c("n"), " of ", c("checked"), " checked links lead nowhere"), c("evidence")),
        Rule(~c("internal"), "technical", "MINOR", "Links to external pages that no longer exist", say(c("n"), " outbound link(s) are dead"), c("evidence")),
    ]
    return grade(rows, rules, c("page"), [k for k in keys if k != "page"])


def classify_navigations(fetches: DataFrame) -> DataFrame:
    """Whether a page could be had, and its status."""
    timed_out = F.col("error").rlike("(?i)Timeout \\d+ms exceeded")
    failed = F.col("error").isNotNull() & (F.col("error") != "")
    availability = (
        F.when(failed, F.when(timed_out, F.lit("timeout")).otherwise(F.lit("unreachable")))
        .when(F.col("status").isNull(), F.lit("unreachable"))
        .when(F.col("status") >= 400, F.lit("http_error"))
        .otherwise(F.lit("ok"))
    )
    return fetches.withColumn("availability", availability).withColumn("http_status", F.when(~failed, F.col("status")))


def grade_navigations(fetches: DataFrame, keys: Sequence[str] = ("audit_id", "store_id")) -> DataFrame:
    """The issue an unavailable page stands for."""
    c = F.col
    failed = c("error").isNotNull() & (c("error") != "")
    rules = [
        Rule(failed, "technical", "CRITICAL", F.when(c("availability") == "timeout", F.lit("Page did not finish loading")).otherwise(F.lit("Page could not be opened")), c("error"), {"text": c("error"), "actual": say(c("duration_ms"), "ms elapsed")}),
        Rule(~failed & c("status").isNull(), "technical", "CRITICAL", "Page could not be opened", "There was no answer"),
        Rule(c("availability") == "http_error", "technical", F.when(c("status") >= 500, F.lit("CRITICAL")).otherwise(F.lit("MAJOR")), say("Page returns HTTP ", c("status")), None, {"status": c("status"), "expected": "200", "actual": c("status").cast("string")}),
    ]
    whole = classify_navigations(fetches).withColumn("error", F.coalesce("error", F.lit("")))
    return grade(whole, rules, c("page"), keys, where=("url",))


def page_check_summary(checks: DataFrame, keys: Sequence[str] = ("audit_id", "page_no")) -> DataFrame:
    """Checks run and failed per audited page, with the names of all that failed."""
    failed = F.col("status") == "failed"
    counts = checks.groupBy(*keys).agg(F.count(F.lit(1)).alias("run"), F.count_if(failed).alias("failed"))
    names = checks.filter(failed).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("check_no", "name"))).alias("_l"))
    return counts.join(names.select(*keys, F.col("_l")["name"].alias("failed_checks")), list(keys), "left")


def audit_verdict(audits: DataFrame, pages: DataFrame, checks: DataFrame) -> DataFrame:
    """The outcome of an audit and why.

    ``audits``: audit_id, blocked, vendor, signal; ``pages``: audit_id, page,
    availability; ``checks`` as in ``page_check_summary``.
    """
    c = F.col
    ok = c("availability") == "ok"
    seen = pages.groupBy("audit_id").agg(
        F.bool_or((c("page") == "homepage") & ok).alias("home_ok"),
        F.bool_or((c("page") == "collection") & (c("availability") != "not_found")).alias("has_collection"),
        F.bool_or((c("page") == "product") & (c("availability") != "not_found")).alias("has_product"),
    )
    failed = page_check_summary(checks, ("audit_id",)).select("audit_id", c("failed").alias("failed_checks_n"), "failed_checks")
    no = F.lit(False)
    n = F.coalesce("failed_checks_n", F.lit(0))
    status = (
        F.when(F.coalesce("blocked", no), F.lit("BLOCKED"))
        .when(~F.coalesce("home_ok", no), F.lit("FAILED"))
        .when((n > 0) | ~F.coalesce("has_product", no) | ~F.coalesce("has_collection", no), F.lit("PARTIAL"))
        .otherwise(F.lit("OK"))
    )
    reason = (
        F.when(c("status") == "BLOCKED", F.trim(F.concat(F.lit("blocked by "), F.coalesce("vendor", F.lit("bot protection")), F.lit(": "), F.coalesce("signal", F.lit("")))))
        .when(c("status") == "FAILED", F.lit("no homepage"))
        .when((c("status") == "PARTIAL") & (n > 0), F.concat(n.cast("string"), F.lit(" failed: "), F.array_join("failed_checks", ", ")))
        .when(c("status") == "PARTIAL", F.lit("a key page is missing"))
    )
    return (
        audits.join(seen, "audit_id", "left").join(failed, "audit_id", "left")
        .withColumn("status", status).withColumn("reason", reason)
        .select("audit_id", "status", "reason")
    )
