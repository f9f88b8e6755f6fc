"""Review of mappings: decisions applied to a mapping table, and whether a column's values fit a target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The status that each decision leads to; an edit keeps it.
STATUS = {"approve": "approved", "reject": "rejected", "ignore": "ignored", "clarify": "needs_clarification", "reopen": "suggested"}


def decide(mappings: DataFrame, decisions: DataFrame, catalog: DataFrame) -> DataFrame:
    """mappings (dataset, source_field, target, status, origin) after decisions (dataset, source_field, action, target).

    approve and edit may name a target, which then counts as manual. Adds `refused`: unknown actions and targets, edits
    without a target and approvals of nothing leave the row as it is.
    """
    known = catalog.select(F.col("target").alias("known_target"))
    d = decisions.select("dataset", "source_field", "action", F.col("target").alias("new_target"))
    j = mappings.join(d, ["dataset", "source_field"], "left").join(known, F.coalesce("new_target", "target") == F.col("known_target"), "left")
    action = F.col("action")
    settles = action.isin("approve", "edit")
    refused = action.isNotNull() & (~action.isin(*STATUS, "edit") | (settles & F.col("known_target").isNull()) | ((action == "edit") & F.col("new_target").isNull()))
    refused = F.coalesce(refused, F.lit(False))
    moved = ~refused & settles & F.col("new_target").isNotNull() & ~F.col("new_target").eqNullSafe(F.col("target"))
    status = F.element_at(F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv]), action)
    return j.select(
        "dataset", "source_field", F.when(moved, F.col("new_target")).otherwise(F.col("target")).alias("target"),
        F.when(~refused, F.coalesce(status, F.col("status"))).otherwise(F.col("status")).alias("status"),
        F.when(moved | (~refused & (action == "edit")), "manual").otherwise(F.col("origin")).alias("origin"), refused.alias("refused"),
    )


DECIDED = ("approved", "rejected", "ignored")


def upsert(existing: DataFrame, proposals: DataFrame, fields: DataFrame, questions: DataFrame, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """(mappings, questions) after proposals for the fields that a profile knows: one join, one row a field.

    existing: dataset, source_field, target, status, origin, confidence, decided_by. proposals: dataset, source_field,
    target, origin, confidence, asks, question. fields: dataset, source_field. questions: dataset, source_field, status,
    question. Decided fields and those with an open question stay as they are, unless `force`; suggestions are replaced. A
    proposal that asks needs a clarification and puts a question; with `force` open ones of its field are withdrawn.
    Mappings tell whether they were `written` or `kept`; both are false for fields without a proposal.
    """
    key = ["dataset", "source_field"]
    open_ = questions.where("status = 'open'").select(*key).distinct().withColumn("_open", F.lit(True))
    said = proposals.join(fields.select(*key).distinct(), key, "left_semi").select(*key, F.struct("target", "origin", "confidence", F.coalesce("asks", F.lit(False)).alias("asks"), "question").alias("_new"))
    held = existing.select(*key, F.struct("target", "status", "origin", "confidence", "decided_by").alias("_old"))
    both = held.join(said, key, "full").join(open_, key, "left")
    settled = F.col("_old.status").isin(*DECIDED) | ((F.col("_old.status") == "needs_clarification") & F.col("_open").isNotNull())
    kept = F.col("_new").isNotNull() & F.coalesce(settled, F.lit(False)) & F.lit(not force)
    written = F.col("_new").isNotNull() & ~kept
    pick = lambda name, new: F.when(F.col("written"), new).otherwise(F.col(f"_old.{name}")).alias(name)
    both = both.withColumns({"written": written, "kept": kept})
    mappings = both.select(
        *key,
        pick("target", F.col("_new.target")),
        pick("status", F.when(F.col("_new.asks"), "needs_clarification").otherwise("suggested")),
        pick("origin", F.col("_new.origin")),
        pick("confidence", F.col("_new.confidence")),
        pick("decided_by", F.lit(None).cast("string")),
        "written",
        "kept",
    )
    asked = both.where("written and _new.asks").select(*key, F.lit("open").alias("status"), F.coalesce("_new.question", F.concat(F.lit("What is "), "source_field", F.lit("?"))).alias("question"))
    again = both.where("written and _old is not null").select(*key).withColumn("_again", F.lit(True)) if force else None
    old = questions.select(*key, "status", "question")
    if again is not None:
        gone = (F.col("status") == "open") & F.col("_again").isNotNull()
        old = old.join(again, key, "left").select(*key, F.when(gone, "withdrawn").otherwise(F.col("status")).alias("status"), "question")
    return mappings, old.unionByName(asked)


def bulk_approve(mappings: DataFrame, reviewer: str, min_confidence: float | None = None, floor: float = 0.9) -> DataFrame:
    """mappings (target, status, confidence, asks and more) with every sure suggestion approved; adds `bulk`: approved, skipped or null.

    Nobody can ask for less than the floor. Suggestions without a target are left alone, and count as neither.
    """
    sure = F.coalesce(F.col("confidence") >= max(min_confidence or 0.0, floor), F.lit(False)) & ~F.coalesce("asks", F.lit(False))
    bulk = F.when((F.col("status") == "suggested") & F.col("target").isNotNull(), F.when(sure, "approved").otherwise("skipped"))
    out = mappings.withColumn("bulk", bulk)
    done = F.coalesce(F.col("bulk") == "approved", F.lit(False))
    return out.withColumns({"status": F.when(done, "approved").otherwise(F.col("status")), "decided_by": F.when(done, reviewer).otherwise(F.col("decided_by"))})


def fit(kind: Column, inferred: Column, changed: Column) -> Column:
    """ok, transform or incompatible for values of an inferred type in a target of some kind.

    changed: cells that are not yet as the target wants them (other formats, symbols, placeholders, malformed ones).
    """
    needs = {"date": ["date", "datetime"], "datetime": ["date", "datetime"], "integer": ["integer", "decimal"], "decimal": ["integer", "decimal"], "boolean": ["boolean"], "email": ["email"], "url": ["url"]}
    wrong = F.lit(False)
    for k, types in needs.items():
        wrong = wrong | ((kind == k) & ~inferred.isin(types))
    narrowed = ((kind == "integer") & (inferred == "decimal")) | (kind.isin("date", "datetime") & (kind != inferred))
    return F.when((inferred == "empty") | wrong, "incompatible").when(narrowed | (kind == "list") | (changed > 0), "transform").otherwise("ok")


def status_counts(mappings: DataFrame) -> DataFrame:
    return mappings.groupBy("dataset", "status").agg(F.count("*").alias("n"))
