"""Reconciliation: ledgers of a run against what the target holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COUNTS = ["source_rows", "built", "skipped", "excluded", "explained", "valid", "attempted", "blocked", "not_attempted", "accepted", "rejected", "failed"]


def ledger(records: DataFrame) -> DataFrame:
    """One row per entity from records (entity, skipped, first_error, outcome).

    outcome is null for what is not valid; else accepted, rejected, failed, blocked or not_attempted.
    """
    o, n = F.col("outcome"), F.count_if
    excluded = ~F.col("skipped") & F.col("first_error").isNotNull()
    return records.groupBy("entity").agg(
        F.count("*").alias("source_rows"), F.count("*").alias("built"), n(F.col("skipped")).alias("skipped"), n(excluded).alias("excluded"), n(excluded).alias("explained"), n(o.isNotNull()).alias("valid"),
        n(o.isin("accepted", "rejected", "failed")).alias("attempted"), *[n(F.coalesce(o == k, F.lit(False))).alias(k) for k in ("blocked", "not_attempted", "accepted", "rejected", "failed")],
    )


def id_difference(accepted: DataFrame, held: DataFrame, refused: DataFrame) -> DataFrame:
    """(entity, id, kind): accepted but missing, held but not accepted, refused and yet there. One full join on the id."""
    a = accepted.select("entity", "id").distinct().withColumn("a", F.lit(True))
    h = held.select("entity", "id").distinct().withColumn("h", F.lit(True))
    r = refused.select("entity", "id").distinct().withColumn("r", F.lit(True))
    both = a.join(h, ["entity", "id"], "full").join(r, ["entity", "id"], "left")
    kinds = F.array_compact(F.array(F.when(F.col("a") & F.col("h").isNull(), "missing_in_target"), F.when(F.col("h") & F.col("a").isNull(), "unexpected_in_target"), F.when(F.col("r") & F.col("h"), "refused_but_present")))
    return both.select("entity", "id", F.explode(kinds).alias("kind"))


def first_errors(records: DataFrame) -> DataFrame:
    """(entity, first_error, n): why records are excluded, by the first error that each met; skipped ones are none."""
    return records.where("not skipped and first_error is not null").groupBy("entity", "first_error").agg(F.count("*").alias("n"))


def checks(ledgers: DataFrame, held: DataFrame, difference: DataFrame, unreadable: tuple[str, ...] = ()) -> DataFrame:
    """Seven checks per entity: (entity, check, expected, actual, ok).

    unreadable: entities that the target would not give back. They fail `target_readable` instead of the two checks of
    what the target holds.
    """
    in_target = held.groupBy("entity").agg(F.countDistinct("id").alias("in_target"))
    off = difference.groupBy("entity").agg(F.count_if(F.col("kind") == "missing_in_target").alias("missing"), F.count_if(F.col("kind") == "unexpected_in_target").alias("unexpected"))
    f = ledgers.join(in_target, "entity", "left").join(off, "entity", "left").fillna(0, ["in_target", "missing", "unexpected"])
    c = F.col
    rows: list[tuple[str, Column, Column, Column | None]] = [
        ("rows_to_records", c("source_rows"), c("built"), None),
        ("records_accounted", c("built"), c("skipped") + c("excluded") + c("valid"), None),
        ("exclusions_explained", c("excluded"), c("explained"), None),
        ("valid_accounted", c("valid"), c("attempted") + c("blocked") + c("not_attempted"), None),
        ("sent_accounted", c("attempted"), c("accepted") + c("rejected") + c("failed"), None),
        ("target_count", c("accepted"), c("in_target"), None),
        ("target_ids", c("accepted"), c("accepted") - c("missing"), (c("missing") == 0) & (c("unexpected") == 0)),
    ]
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("check"), e.alias("expected"), a.alias("actual"), (e == a if ok is None else ok).alias("ok")) for k, e, a, ok in rows]))
    out = f.select("entity", each.alias("x")).select("entity", "x.*")
    if not unreadable:
        return out
    lost = F.col("entity").isin(*unreadable)
    unread = ledgers.where(lost).select("entity", F.lit("target_readable").alias("check"), F.col("accepted").alias("expected"), F.lit(0).cast("long").alias("actual"), F.lit(False).alias("ok"))
    return out.where(~(lost & F.col("check").isin("target_count", "target_ids"))).unionByName(unread)


SAMPLE_IDS = 10


def discrepancies(found: DataFrame, difference: DataFrame) -> DataFrame:
    """(entity, kind, count, sample_ids): what is not as it should be; records left out for a stated reason are none.

    Ids that are missing or unexpected come with the smallest few; a failed count comes with its difference.
    """
    off = difference.where(F.col("kind").isin("missing_in_target", "unexpected_in_target"))
    nth = F.row_number().over(Window.partitionBy("entity", "kind").orderBy("id"))
    few = off.withColumn("nth", nth).where(F.col("nth") <= SAMPLE_IDS).groupBy("entity", "kind").agg(F.array_join(F.sort_array(F.collect_list("id")), ",").alias("sample_ids"))
    ids = off.groupBy("entity", "kind").agg(F.count("*").alias("count")).join(few, ["entity", "kind"])
    counts = found.where(~F.col("ok") & ~F.col("check").isin("target_count", "target_ids", "target_readable"))
    return ids.unionByName(counts.select("entity", F.col("check").alias("kind"), F.abs(F.col("expected") - F.col("actual")).alias("count"), F.lit("").alias("sample_ids")))


def status(found: DataFrame) -> DataFrame:
    """One row: checks, passed, status. Without checks nothing is off."""
    out = found.agg(F.count("*").alias("checks"), F.count_if("ok").alias("passed"))
    return out.withColumn("status", F.when(F.col("checks") == F.col("passed"), "balanced").otherwise("discrepancies"))


def recheck(then: DataFrame, now: DataFrame) -> DataFrame:
    """Checks that come out otherwise than when the run made them: (entity, check, actual_then, actual_now, ok_then, ok_now)."""
    old = then.select("entity", "check", F.col("actual").alias("actual_then"), F.col("ok").alias("ok_then"))
    new = now.select("entity", "check", F.col("actual").alias("actual_now"), F.col("ok").alias("ok_now"))
    both = old.join(new, ["entity", "check"], "full")
    moved = ~F.col("actual_then").eqNullSafe(F.col("actual_now")) | ~F.col("ok_then").eqNullSafe(F.col("ok_now"))
    return both.where(moved).select("entity", "check", "actual_then", "actual_now", "ok_then", "ok_now")


def totals(ledgers: DataFrame) -> DataFrame:
    return ledgers.agg(*[F.sum(k).alias(k) for k in COUNTS])


def coverage(ledgers: DataFrame) -> DataFrame:
    """(entity, in_scope, accepted, coverage): the counts that gates are judged by, and their quotient for a reader."""
    scope = F.col("built") - F.col("skipped")
    return ledgers.select("entity", scope.alias("in_scope"), "accepted", F.when(scope > 0, F.bround(F.col("accepted") / scope, 4)).alias("coverage"))
