"""Model answers checked against closed schemas, and what they rest on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retailscope.functions.numbers import round_half_up
from retailscope.functions.ranks import PAGES, SEVERITIES
from retailscope.operators.once import once
from retailscope.operators.scoring import LEAD_CATEGORIES, PRIORITIES

# What an analyst's finding may say.
ISSUE_CATEGORIES = ("technical", "performance", "ux", "cro", "seo")
QC_CHECKS = ("facts", "personalisation", "category", "tone", "pushiness")
QC_VERDICTS = ("PASS", "FAIL", "NOT_CHECKED")
SCORES = ("ux", "cro", "seo", "performance")
_NUMBER = "^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)"


def _at(document: Column, path: str) -> Column:
    return F.try_variant_get(document, path, "variant")


def _kind(document: Column, path: str) -> Column:
    return F.coalesce(F.schema_of_variant(_at(document, path)), F.lit("MISSING"))


def _problem(bad: Column, path: str, what: str) -> Column:
    return F.when(bad, F.lit(f"{path}: {what}"))


def text_at(document: Column, path: str, filled: bool = True) -> list[Column]:
    """Problems of a text field."""
    wrong = _kind(document, f"$.{path}") != "STRING"
    checks = [_problem(wrong, path, "expected text")]
    if filled:
        checks.append(_problem(~wrong & (F.try_variant_get(document, f"$.{path}", "string") == ""), path, "must not be empty"))
    return checks


def one_of_at(document: Column, path: str, values: tuple[str, ...]) -> list[Column]:
    value = F.try_variant_get(document, f"$.{path}", "string")
    is_text = _kind(document, f"$.{path}") == "STRING"
    return [_problem(~(is_text & F.coalesce(value.isin(*values), F.lit(False))), path, "not an allowed value")]


def number_at(document: Column, path: str) -> list[Column]:
    return [_problem(~_kind(document, f"$.{path}").rlike(_NUMBER), path, "expected a number")]


def list_at(document: Column, path: str) -> list[Column]:
    return [_problem(~_kind(document, f"$.{path}").startswith("ARRAY"), path, "expected a list")]


def items_at(document: Column, path: str, check) -> list[Column]:
    """Problems of list members: the path of the first bad one."""
    items = F.coalesce(F.try_variant_get(document, f"$.{path}", "array<variant>"), F.array().cast("array<variant>"))
    said = F.transform(items, lambda e: F.concat_ws("; ", *check(e)))
    problems = F.transform(said, lambda s, i: F.when(s != "", F.concat(F.lit(f"{path}."), i.cast("string"), F.lit("."), s)))
    return [F.try_element_at(F.filter(problems, lambda p: p.isNotNull()), F.lit(1))]


def _issue(e: Column) -> list[Column]:
    return [
        _problem(~_kind(e, "$.evidenceId").rlike("^(TINYINT|SMALLINT|INT|BIGINT)"), "evidenceId", "expected a whole number"),
        *one_of_at(e, "page", PAGES),
        *one_of_at(e, "category", ISSUE_CATEGORIES),
        *one_of_at(e, "severity", SEVERITIES),
        *text_at(e, "title"),
        *text_at(e, "impact"),
    ]


def _texts(e: Column) -> list[Column]:
    return [_problem(F.coalesce(F.schema_of_variant(e), F.lit("MISSING")) != "STRING", "item", "expected text")]


def _schema(document: Column, kind: str) -> list[Column]:
    if kind == "analyst":
        return [
            *list_at(document, "issues"), *items_at(document, "issues", _issue),
            *[p for s in SCORES for p in number_at(document, f"scores.{s}")],
            *list_at(document, "signals.strengths"), *items_at(document, "signals.strengths", _texts),
            *text_at(document, "signals.momentum", filled=False),
            _problem(_kind(document, "$.signals.insufficientEvidence") != "BOOLEAN", "signals.insufficientEvidence", "expected true or false"),
        ]
    if kind == "classifier":
        return [*one_of_at(document, "category", LEAD_CATEGORIES[:-1]), *one_of_at(document, "priority", PRIORITIES), *text_at(document, "reason")]
    if kind == "letter":
        return [*text_at(document, "subject"), *text_at(document, "body"), *list_at(document, "factsUsed"), *items_at(document, "factsUsed", _texts)]
    if kind == "review":
        return [p for name in QC_CHECKS for p in (*one_of_at(document, f"{name}.verdict", QC_VERDICTS), *text_at(document, f"{name}.reason"))]
    if kind == "people":
        return [*list_at(document, "people"), *items_at(document, "people", lambda e: [*text_at(e, "name"), *text_at(e, "role", filled=False), *text_at(e, "quote")])]
    raise ValueError(f"no schema {kind!r}")


def validate_answers(answers: DataFrame, kind: str, text: str = "text") -> DataFrame:
    """Answers with ``valid`` and, where not, the ``problem`` with its path.

    A field of the wrong type is a problem, not a null: types are read from the
    document before any value is.
    """
    parsed = once(answers, document=F.try_parse_json(text))
    judged = once(parsed, _problems=F.concat_ws("; ", *_schema(F.col("document"), kind)))
    problem = F.when(F.col("document").isNull(), F.lit("not JSON")).otherwise(F.when(F.col("_problems") != "", F.col("_problems")))
    return judged.withColumn("problem", problem).drop("_problems").withColumn("valid", F.col("problem").isNull())


def clamped_scores(answers: DataFrame) -> DataFrame:
    """Valid analyst answers with their scores rounded into 0 to 100."""
    read = lambda s: F.try_variant_get("document", f"$.scores.{s}", "double")
    clamp = lambda v: F.least(F.lit(100), F.greatest(F.lit(0), round_half_up(v))).cast("int")
    return answers.filter("valid").select("store_id", *[clamp(read(s)).alias(f"score_{s}") for s in SCORES])


def explode_findings(answers: DataFrame) -> DataFrame:
    """Findings of valid analyst answers, one row each."""
    shape = "array<struct<evidenceId bigint, page string, category string, severity string, title string, impact string>>"
    issues = F.try_variant_get("document", "$.issues", shape)
    rows = answers.filter("valid").select("store_id", "audit_id", F.posexplode_outer(issues).alias("pos", "i")).filter(F.col("i").isNotNull())
    return rows.select(
        "store_id", "audit_id", "pos", F.col("i.evidenceId").alias("evidence_id"), "i.page", "i.category", "i.severity", "i.title", "i.impact"
    )


def ground_findings(findings: DataFrame, issues: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Findings that cite an issue of their audit, and those that do not."""
    known = issues.select("audit_id", F.col("id").alias("evidence_id")).distinct()
    keys = ["audit_id", "evidence_id"]
    kept = findings.join(known, keys, "left_semi")
    dropped = findings.join(known, keys, "left_anti").withColumn("reason", F.lit("unknown-evidence-id"))
    return kept, dropped
