"""The shop list: one row per shop with its latest state."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retailscope.operators.keyed import even_slices, first_per_key, id_slice, latest_per_key, list_parts
from retailscope.session import cut_lineage

CLASSIFIER = "lead_classifier"


def severity_counts(issues: DataFrame, key: str | Sequence[str] = "store_id") -> DataFrame:
    """Issues per key and severity."""
    keys = [key] if isinstance(key, str) else list(key)
    count = lambda name: F.count_if(F.col("severity") == name)
    return issues.groupBy(*keys).agg(
        count("CRITICAL").alias("critical_issues"),
        count("MAJOR").alias("major_issues"),
        count("MINOR").alias("minor_issues"),
    )


def latest_audit_issues(issues: DataFrame) -> DataFrame:
    """Issues of the newest audit that has any, per shop."""
    newest = issues.groupBy("store_id").agg(F.max("audit_id").alias("audit_id"))
    return issues.join(newest, ["store_id", "audit_id"], "left_semi")


def best_person(contacts: DataFrame) -> DataFrame:
    """The person to write to: primary first, then the most certain."""
    order = [F.col("is_primary").desc(), F.col("confidence").desc(), F.col("id").asc()]
    return first_per_key(contacts.filter(~F.col("is_generic")), ["store_id"], order)


def best_profile_link(contacts: DataFrame) -> DataFrame:
    """A personal profile before a company page, then as ``best_person``."""
    personal = F.col("linkedin_url").contains("/in/")
    order = [personal.desc(), F.col("is_primary").desc(), F.col("confidence").desc(), F.col("id").asc()]
    return first_per_key(contacts.filter(F.col("linkedin_url").isNotNull()), ["store_id"], order)


def shared_inboxes(contacts: DataFrame, per_part: int = 500) -> DataFrame:
    """Generic addresses per shop joined by a blank in insertion order.

    A shop with more than ``per_part`` of them continues in part 1, 2, …
    """
    generic = contacts.filter(F.col("is_generic") & F.col("email").isNotNull())
    parts = list_parts(generic, ["store_id"], [F.col("id")], id_slice("id"), F.col("email"), per_part)
    return parts.select("store_id", "part", F.array_join("items", " ").alias("generic_emails"), F.col("n").alias("generic_count"))


def status_counts(df: DataFrame, column: str = "status") -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).filter(F.col(column).isNotNull()).distinct()


def store_overview(
    stores: DataFrame,
    analyses: DataFrame,
    issues: DataFrame,
    letters: DataFrame,
    contacts: DataFrame,
    issue_scope: str = "all",
) -> DataFrame:
    """One row per shop: classification, issues, letter, person, link, inboxes.

    Every side is reduced to one row per shop before it is joined. The inbox
    list joins all parts of ``shared_inboxes``.
    """
    classified = latest_per_key(
        analyses.filter(F.col("agent") == CLASSIFIER).select("store_id", "id", "category", "lead_score"),
        ["store_id"],
        ["id"],
    ).drop("id")
    counted = severity_counts(latest_audit_issues(issues) if issue_scope == "latest" else issues)
    letter = latest_per_key(letters.select("store_id", "version", "status"), ["store_id"], ["version"])
    person = best_person(contacts).select(
        "store_id",
        F.col("name").alias("contact_name"),
        F.col("role").alias("contact_role"),
        F.col("email").alias("contact_email"),
        F.col("confidence").alias("contact_confidence"),
    )
    link = best_profile_link(contacts).select("store_id", F.col("linkedin_url").alias("contact_linkedin"))
    inboxes = shared_inboxes(contacts)
    inbox_totals = inboxes.groupBy("store_id").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("part", "generic_emails")))["generic_emails"], " ").alias("generic_emails"),
        F.sum("generic_count").alias("generic_count"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    joined = stores.withColumnRenamed("id", "store_id")
    for side in (
        classified,
        counted.drop("minor_issues"),
        letter.select("store_id", F.col("status").alias("email_status")),
        person,
        link,
        inbox_totals,
    ):
        joined = joined.join(side, "store_id", "left")
    return joined.select(
        F.col("store_id").alias("id"),
        *[c for c in stores.columns if c != "id"],
        "category",
        "lead_score",
        zero("critical_issues"),
        zero("major_issues"),
        "email_status",
        "contact_name",
        "contact_role",
        "contact_email",
        "contact_confidence",
        "contact_linkedin",
        "generic_emails",
        zero("generic_count"),
    )


def filter_stores(
    overview: DataFrame,
    domain: str | None = None,
    rank_min: int | None = None,
    rank_max: int | None = None,
    score_min: float | None = None,
    score_max: float | None = None,
    revenue_min: float | None = None,
    revenue_max: float | None = None,
    issues_min: int | None = None,
    issues_max: int | None = None,
    status: str | None = None,
    email: str | None = None,
    category: str | None = None,
    severity: str | None = None,
) -> DataFrame:
    """Keeps the shops that meet every filter given; bounds of money in units."""
    score = F.coalesce("lead_score", F.lit(0))
    total = F.col("critical_issues") + F.col("major_issues")
    conditions: list[Column] = []

    def add(value, build):
        if value is not None and value != "":
            conditions.append(build(value))

    add(domain, lambda v: F.lower("domain").contains(v.lower()))
    add(rank_min, lambda v: F.col("rank") >= v)
    add(rank_max, lambda v: F.col("rank") <= v)
    add(score_min, lambda v: score >= v)
    add(score_max, lambda v: score <= v)
    add(revenue_min, lambda v: F.col("revenue_estimate") >= v * 100)
    add(revenue_max, lambda v: F.col("revenue_estimate") <= v * 100)
    add(issues_min, lambda v: total >= v)
    add(issues_max, lambda v: total <= v)
    add(status, lambda v: F.col("status") == v)
    add(email, lambda v: F.col("email_status") == v)
    add(category, lambda v: F.col("category") == v)
    if severity in ("CRITICAL", "MAJOR"):
        conditions.append(F.col(f"{severity.lower()}_issues") > 0)
    out = overview
    for condition in conditions:
        out = out.filter(condition)
    return out


# Sort keys, the column behind each and its first direction.
SORT_KEYS: dict[str, tuple[str, str]] = {
    "domain": ("domain", "asc"),
    "rank": ("rank", "asc"),
    "score": ("lead_score", "desc"),
    "revenue": ("revenue_estimate", "desc"),
    "issues": ("critical_issues * 1000 + major_issues", "desc"),
    "status": ("status", "asc"),
    "contact": ("coalesce(contact_name, contact_email)", "asc"),
    "linkedin": ("contact_linkedin", "asc"),
    "shared": ("generic_count", "desc"),
    "email": ("email_status", "asc"),
    "added": ("id", "desc"),
}
DEFAULT_SORT = "score"


def _sorting(key: str | None, direction: str | None) -> tuple[Column, bool]:
    """The value sorted by and whether it ascends."""
    chosen = key if key in SORT_KEYS else DEFAULT_SORT
    expression, first_direction = SORT_KEYS[chosen]
    return F.expr(expression), (direction if direction in ("asc", "desc") else first_direction) == "asc"


def sort_stores(overview: DataFrame, key: str | None = None, direction: str | None = None) -> DataFrame:
    """Orders the shop list; shops without a value come last either way."""
    value, ascending = _sorting(key, direction)
    return overview.orderBy(
        value.asc_nulls_last() if ascending else value.desc_nulls_last(), F.col("id").asc()
    )


@dataclass(frozen=True)
class PageInfo:
    page: int
    page_size: int
    total_pages: int
    total: int
    offset: int
    first: int
    last: int

    @property
    def has_previous(self) -> bool:
        return self.page > 1

    @property
    def has_next(self) -> bool:
        return self.page < self.total_pages


DEFAULT_PAGE_SIZE = 20
MAX_PAGE_SIZE = 200


def page_info(total: int, page: int = 1, size: int = DEFAULT_PAGE_SIZE) -> PageInfo:
    """Page numbers clamped to what exists; an empty table has one empty page."""
    total = max(0, total)
    size = min(max(1, size), MAX_PAGE_SIZE)
    pages = max(1, -(-total // size))
    current = min(max(1, page), pages)
    offset = (current - 1) * size
    return PageInfo(current, size, pages, total, offset, offset + 1 if total else 0, min(offset + size, total))


def page_of(overview: DataFrame, key: str | None = None, direction: str | None = None, page: int = 1, size: int = DEFAULT_PAGE_SIZE) -> tuple[DataFrame, PageInfo]:
    """One page of the shop list in the order of ``sort_stores``, and where it stands.

    The list is worked out once and stored. Its rows are counted in even slices
    along the order (a bounded number of counts), and only the slices that hold
    the page are read again and sorted, so a late page costs what the first does.
    """
    value, ascending = _sorting(key, direction)
    held = cut_lineage(overview)
    # read backwards, descending values with nulls last are ascending ones with nulls first
    along = [value.isNull(), value, F.col("id")] if ascending else [value, -F.col("id")]
    sliced = even_slices(held, [], along, "_page_slice").withColumn("_page_slice", F.col("_page_slice") * (1 if ascending else -1))
    counts = sorted(map(tuple, sliced.groupBy("_page_slice").count().collect()))
    info = page_info(sum(n for _, n in counts), page, size)
    wanted, skipped, before = [], 0, 0
    for piece, n in counts:
        if before + n <= info.offset:
            skipped = before + n
        elif before < info.offset + info.page_size:
            wanted.append(piece)
        before += n
    rows = sort_stores(sliced.filter(F.col("_page_slice").isin(wanted)), key, direction).drop("_page_slice")
    return rows.offset(info.offset - skipped).limit(info.page_size), info


def page_after(overview: DataFrame, last_id: int | None, last_value: object = None, key: str | None = None, direction: str | None = None, size: int = DEFAULT_PAGE_SIZE) -> DataFrame:
    """The rows that follow a given one in the order of ``sort_stores``, the first ones for no id.

    Each task keeps ``size`` rows, however far down the list the page is.
    """
    value, ascending = _sorting(key, direction)
    size = min(max(1, size), MAX_PAGE_SIZE)
    if last_id is None:
        return sort_stores(overview, key, direction).limit(size)
    same = value.isNull() if last_value is None else value == last_value
    beyond = F.lit(False) if last_value is None else value.isNull() | (value > last_value if ascending else value < last_value)
    return sort_stores(overview.filter(beyond | (same & (F.col("id") > last_id))), key, direction).limit(size)


def recent_runs(runs: DataFrame, n: int = 50) -> DataFrame:
    return runs.orderBy(F.col("id").desc()).limit(n)
