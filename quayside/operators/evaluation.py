"""Evaluation of proposed mappings against known ones, once and over several runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUTCOMES = ("correct", "deferred", "unresolved", "wrong", "overconfident")

#: What is wanted of a field, what was proposed, and the outcome without and with a question asked.
_TABLE = {
    ("question", "none"): ("wrong", "correct"),
    ("question", "accepted"): ("overconfident", "correct"),
    ("question", "other"): ("wrong", "wrong"),
    ("nothing", "none"): ("correct", "correct"),
    ("nothing", "accepted"): ("correct", "correct"),
    ("nothing", "other"): ("wrong", "wrong"),
    ("target", "none"): ("unresolved", "deferred"),
    ("target", "accepted"): ("correct", "correct"),
    ("target", "other"): ("wrong", "wrong"),
    ("target or question", "none"): ("unresolved", "correct"),
    ("target or question", "accepted"): ("correct", "correct"),
    ("target or question", "other"): ("wrong", "wrong"),
}

# The metrics that are followed over several runs.
SERIES = ["correct", "accuracy", "target_correct", "wrong", "overconfident", "deferred", "unresolved", "incorrect_high_confidence", "clarification_recall", "clarification_false_positives", "mean_confidence_correct", "mean_confidence_incorrect"]


def judge(golden: DataFrame, proposals: DataFrame) -> DataFrame:
    """Each field of golden with its outcome; a field without a proposal is unresolved, whatever was wanted of it.

    golden: dataset, source_field, expected (null: no target), accept (other targets that pass), clarify (the right
    answer is a question), clarify_ok (a question passes too), and transformation (the values need one) if known.
    proposals: dataset, source_field, target, asks, confidence, and transforms (says that values need one) if known.
    """
    yes = lambda c, df: F.coalesce(F.col(c), F.lit(False)) if c in df.columns else F.lit(False)
    said = proposals.select(
        "dataset",
        "source_field",
        F.col("target").alias("proposed"),
        yes("asks", proposals).alias("asks"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        yes("transforms", proposals).alias("transforms"),
        F.lit(True).alias("_there"),
    )
    known = golden.select("dataset", "source_field", "expected", "accept", *[yes(c, golden).alias(c) for c in ("clarify", "clarify_ok", "transformation")])
    j = known.join(said, ["dataset", "source_field"], "left").withColumns(
        {"asks": F.coalesce("asks", F.lit(False)), "transforms": F.coalesce("transforms", F.lit(False)), "confidence": F.coalesce("confidence", F.lit(0.0))}
    )
    wanted = (
        F.when(F.col("clarify"), "question")
        .when(F.col("expected").isNull(), "nothing")
        .when(F.col("clarify_ok"), "target or question")
        .otherwise("target")
    )
    passes = F.coalesce(F.array_contains("accept", F.col("proposed")), F.lit(False))
    meant = ~F.col("clarify") & F.coalesce(F.col("proposed") == F.col("expected"), F.lit(False))
    proposed = F.when(F.col("proposed").isNull(), "none").when(passes | meant, "accepted").otherwise("other")
    cases = [(F.lit(f"{w}/{p}"), F.array(*map(F.lit, both))) for (w, p), both in _TABLE.items()]
    both = F.element_at(F.create_map(*[x for case in cases for x in case]), F.concat_ws("/", wanted, proposed))
    outcome = F.when(F.col("_there").isNull(), "unresolved").otherwise(F.get(both, F.col("asks").cast("int")))
    return j.select("dataset", "source_field", "expected", "clarify", "clarify_ok", "transformation", "proposed", "asks", "transforms", "confidence", outcome.alias("outcome"))


def metrics(rows: DataFrame, *by: str, high_confidence: float = 0.9) -> DataFrame:
    """What a reader is told of judged fields, per `by` or in all. Shares and means have three places, and are null over nothing.

    Incorrect are wrong and overconfident ones; deferred and unresolved are neither right nor wrong. A question counts as a
    false positive where none was wanted or allowed. Recall of transformations is among fields that are right.
    """
    c, n = F.col, F.count_if
    right = c("outcome") == "correct"
    incorrect = c("outcome").isin("wrong", "overconfident")
    target = c("expected").isNotNull()
    changed = c("transformation") & right & c("proposed").isNotNull()
    part = lambda some, of: F.bround(F.when(of > 0, some / of), 3)
    mean = lambda of: F.bround(F.avg(F.when(of, c("confidence"))), 3)
    return rows.groupBy(*by).agg(
        F.count("*").alias("fields"),
        *[n(c("outcome") == o).alias(o) for o in OUTCOMES],
        part(n(right), F.count("*")).alias("accuracy"),
        n(target).alias("target_fields"),
        n(target & right).alias("target_correct"),
        part(n(target & right), n(target)).alias("target_accuracy"),
        n(c("clarify")).alias("clarify_expected"),
        n(c("clarify") & c("asks")).alias("clarify_flagged"),
        part(n(c("clarify") & c("asks")), n(c("clarify"))).alias("clarification_recall"),
        n(c("asks") & ~c("clarify") & ~c("clarify_ok")).alias("clarification_false_positives"),
        part(n(changed & c("transforms")), n(changed)).alias("transformation_flag_recall"),
        n(incorrect & (c("confidence") >= high_confidence)).alias("incorrect_high_confidence"),
        mean(right).alias("mean_confidence_correct"),
        mean(incorrect).alias("mean_confidence_incorrect"),
    )


def series(rows: DataFrame, high_confidence: float = 0.9) -> DataFrame:
    """(metric, least, most, mean) over runs; rows have a column `run`. A metric that a run does not have is left out there."""
    each = metrics(rows, "run", high_confidence=high_confidence)
    long = each.select("run", *[F.col(c).cast("double").alias(c) for c in SERIES]).unpivot(["run"], SERIES, "metric", "value").where("value is not null")
    return long.groupBy("metric").agg(F.min("value").alias("least"), F.max("value").alias("most"), F.bround(F.avg("value"), 3).alias("mean"))


def unstable_fields(rows: DataFrame) -> DataFrame:
    """Fields whose outcome was not the same in all runs: (dataset, source_field, outcomes)."""
    out = rows.groupBy("dataset", "source_field").agg(F.collect_set("outcome").alias("o"))  # a set of five at most
    return out.where(F.size("o") > 1).select("dataset", "source_field", F.array_join(F.sort_array("o"), ",").alias("outcomes"))


def opaque(exports: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """The exports with columns renamed to c01, c02 and so on, a name the same everywhere, and the codes by name."""
    names = dict.fromkeys(c for df in exports.values() for c in df.columns)
    codes = {n: f"c{i:02d}" for i, n in enumerate(names, start=1)}
    return {k: df.withColumnsRenamed(codes) for k, df in exports.items()}, codes
