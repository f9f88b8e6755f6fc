"""Rehearsed writes: idempotent classification, blocked children, early stops, faults, and the store behind them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quayside.functions.texts import canonical
from quayside.plans.contract import ENTITIES
from quayside.plans.shared import barrier
from quayside.plans.stores import Store

LIVE_NAMESPACE = "00000000-0000-0000-0000-000000000000"


def content_hash(payload: str = "payload") -> Column:
    """sha256 of the payload as JSON, nulls included, its names in order at every depth; only equality matters."""
    return F.sha2(canonical(F.to_json(payload, {"ignoreNullFields": "false"})), 256)


def classify_writes(records: DataFrame, existing: DataFrame) -> DataFrame:
    """records (id, content_hash, ord) against existing (id, content_hash): created, unchanged or conflict.

    Within a batch the first of an id is written and later ones are compared with what then stands. Only ids that
    repeat have a first to look up, one row each.
    """
    held = existing.select("id", F.col("content_hash").alias("held_hash"))
    firsts = records.groupBy("id").agg(F.min_by("content_hash", "ord").alias("first_hash"), F.min("ord").alias("first_ord"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    joined = records.join(held, "id", "left").join(firsts, "id", "left")
    stands = F.coalesce("held_hash", "first_hash", "content_hash")
    is_first = F.coalesce(F.col("ord") == F.col("first_ord"), F.lit(True))
    outcome = F.when(F.col("held_hash").isNull() & is_first, "created").when(F.col("content_hash") == stands, "unchanged").otherwise("conflict")
    return joined.withColumn("outcome", outcome).drop("held_hash", "first_hash", "first_ord")


def changed_fields(records: DataFrame, existing: DataFrame) -> DataFrame:
    """(id, ord, changed) for records (id, ord, payload struct) whose stored payload differs: the names of the fields, sorted."""
    names = sorted(f.name for f in records.schema["payload"].dataType.fields)
    j = records.select("id", "ord", "payload").join(existing.select("id", F.col("payload").alias("stored")), "id")
    text = lambda side, n: F.coalesce(F.col(f"{side}.{n}").cast("string"), F.lit("\0"))  # noqa: E731  null is a value here
    changed = F.array_compact(F.array(*[F.when(text("payload", n) != text("stored", n), F.lit(n)) for n in names]))
    return j.select("id", "ord", F.array_join(changed, ",").alias("changed")).where("changed <> ''")


def blocked_children(children: DataFrame, accepted: DataFrame, key: str = "organization_id") -> DataFrame:
    """Children whose organization was not accepted; they are not attempted."""
    return children.where(F.col(key).isNotNull()).join(accepted.select(F.col("id").alias(key)).distinct(), key, "left_anti")


def _cut(rows: DataFrame, limit: int) -> DataFrame:
    """(entity, cut): the place of the `limit`-th row of each entity that has so many. Each task sends `limit` rows of an entity at most."""
    nth = F.row_number().over(Window.partitionBy("entity").orderBy("ord"))
    if limit <= 0:  # before the first
        return rows.groupBy("entity").agg((F.min("ord") - 1).alias("cut"))
    first = rows.select("entity", "ord").withColumn("nth", nth).where(F.col("nth") <= limit)
    return first.groupBy("entity").agg(F.max("ord").alias("cut"), F.count("*").alias("n")).where(F.col("n") == limit).drop("n")


def limit_per_entity(records: DataFrame, limit: int) -> DataFrame:
    """Adds not_attempted: beyond the first `limit` of each entity."""
    out = records.join(_cut(records, limit), "entity", "left")
    return out.withColumn("not_attempted", F.coalesce(F.col("ord") > F.col("cut"), F.lit(False))).drop("cut")


def stop_after_failures(attempts: DataFrame, limit: int) -> DataFrame:
    """Adds not_attempted: after the `limit`-th rejected or failed record of the entity, nothing more is sent."""
    out = attempts.join(_cut(attempts.where(F.col("outcome").isin("rejected", "failed")), limit), "entity", "left")
    return out.withColumn("not_attempted", F.coalesce(F.col("ord") > F.col("cut"), F.lit(False))).drop("cut")


#: Attempts in a stretch of the sequence that one task walks, about.
STRETCH = 1_000_000


def with_runs(attempts: DataFrame) -> DataFrame:
    """Adds position in the order (entity_rank, ord) and run: failures in a row up to here, across entities.

    A failure's run is its distance to the last attempt that did not fail. The order is cut into stretches by a range
    shuffle; each is numbered by itself, and one row per stretch carries its length and its last good place on.
    """
    spark = attempts.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-attempts.count() // STRETCH))
    a = barrier(attempts.repartitionByRange(n, "entity_rank", "ord").withColumn("_stretch", F.spark_partition_id()), "stretches")
    inside = Window.partitionBy("_stretch").orderBy("entity_rank", "ord")
    a = a.withColumn("_at", F.row_number().over(inside))
    fine = F.when(F.col("outcome") != "failed", F.col("_at"))
    a = a.withColumn("_fine", F.max(fine).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    # One row per stretch meets here.
    before = Window.orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    ends = a.groupBy("_stretch").agg(F.max("_at").alias("n"), F.max("_fine").alias("last"))
    ends = ends.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    ends = ends.withColumn("carried", F.coalesce(F.max(F.col("base") + F.col("last")).over(before), F.lit(0))).drop("n", "last")
    a = a.join(ends, "_stretch").withColumn("position", F.col("base") + F.col("_at"))
    run = F.col("position") - F.coalesce(F.col("base") + F.col("_fine"), F.col("carried"))
    return a.withColumn("run", run).drop("_stretch", "_at", "_fine", "base", "carried")


def breaker(attempts: DataFrame, threshold: int) -> DataFrame:
    """Adds run and not_attempted: after the first run of `threshold` failures nothing more is sent."""
    a = barrier(with_runs(attempts), "runs")
    tripped = a.where(F.col("run") >= threshold).agg(F.min("position")).first()[0]
    return a.withColumn("not_attempted", F.lit(False) if tripped is None else F.col("position") > tripped)


# Fixed values.
DORMANT, STARTED = ("inactive", "churned"), ("trial", "active")


def _judged(rows: DataFrame, entity: str, stored: DataFrame) -> DataFrame:
    """rows with outcome and error_type, if of these rows just `stored` were there: each looks at what stands before it."""
    before = lambda c: F.coalesce(F.col(c) < F.col("ord"), F.lit(False))
    by_id = stored.groupBy("id").agg(F.min("ord").alias("_id_at"), F.min_by("content_hash", "ord").alias("_id_hash"))
    out = rows.join(by_id, "id", "left")
    held = F.coalesce("_held_hash", F.when(before("_id_at"), F.col("_id_hash")))
    error = F.col("_own_error")
    if entity == "contact":
        primary = stored.where("is_primary").groupBy("organization_id").agg(F.min("ord").alias("_primary_at"))
        mail = stored.where("email is not null").groupBy("organization_id", F.lower("email").alias("_mail")).agg(F.min("ord").alias("_mail_at"))
        out = out.join(primary, "organization_id", "left").withColumn("_mail", F.lower("email")).join(mail, ["organization_id", "_mail"], "left")
        two = F.coalesce("is_primary", F.lit(False)) & before("_primary_at")
        error = F.coalesce(error, F.when(two, "duplicate_primary_contact"), F.when(before("_mail_at"), "duplicate_contact_email"))
    error = F.when(held.isNull(), error).when(held != F.col("content_hash"), "duplicate_identifier")
    out = out.withColumns({"error_type": error, "_there": held.isNotNull()})
    outcome = F.when(F.col("error_type").isNotNull(), "rejected").when(F.col("_there"), "unchanged").otherwise("created")
    return out.select(*rows.columns, "error_type", outcome.alias("outcome"))


def answers(attempts: DataFrame, entity: str, organizations: DataFrame | None, existing: DataFrame) -> DataFrame:
    """attempts with outcome (created, unchanged, rejected or failed) and error_type, as the target gives them one by one.

    attempts: id, ord, content_hash, fault (whether the target fails), and what the entity's rules read: organization_id;
    is_primary, email; status. organizations: accepted ones (id, status); existing: (id, content_hash) held before.

    What a record finds there depends on which of the earlier ones were let in. So all are judged against a guess of
    what is stored, and again against the outcome, until nothing changes; each round settles the records that hang on
    settled ones. Drafts that are valid need one round; what each record looks up are aggregates of one row per key.
    """
    fault = F.coalesce("fault", F.lit(False))
    down = attempts.where(fault).withColumns({"error_type": F.lit("target_unavailable"), "outcome": F.lit("failed")})
    rows = attempts.where(~fault).join(existing.select("id", F.col("content_hash").alias("_held_hash")), "id", "left")
    own = F.lit(None).cast("string")
    if organizations is not None:
        held = organizations.select(F.col("id").alias("organization_id"), F.col("status").alias("_held"), F.lit(True).alias("_known"))
        rows = rows.join(held, "organization_id", "left")
        own = F.when(F.col("_known").isNull(), "missing_relationship")
        if entity == "subscription":
            own = F.coalesce(own, F.when(F.col("_held").isin(*DORMANT) & F.col("status").isin(*STARTED), "business_rule_violation"))
    rows = barrier(rows.withColumn("_own_error", own).drop("_held", "_known"), f"attempts-{entity}")
    told = barrier(_judged(rows, entity, rows.where("_own_error is null and _held_hash is null")), f"told-{entity}")
    while entity == "contact":
        # What was told last time goes along with each record, so that no join finds what has changed.
        last = told.withColumnsRenamed({"outcome": "_outcome", "error_type": "_error_type"})
        again = barrier(_judged(last, entity, told.where("outcome = 'created'")), f"told-{entity}")
        changed = ~(F.col("outcome").eqNullSafe(F.col("_outcome")) & F.col("error_type").eqNullSafe(F.col("_error_type")))
        same = again.where(changed).isEmpty()
        told = again.drop("_outcome", "_error_type")
        if same:
            break
    return told.drop("_held_hash", "_own_error").unionByName(down)


def dry_run(records: dict[str, DataFrame], limit: int | None = None, stop_after: int | None = None, threshold: int = 10, existing: dict[str, DataFrame] | None = None) -> DataFrame:
    """One row per record: entity, id, ord, outcome, error_type; a rehearsal of all writes in the entities' order.

    outcome: created, unchanged, rejected, failed, blocked (its organization was not accepted) or not_attempted: beyond
    `limit` records of an entity, after `stop_after` refusals of it, or after `threshold` failures in a row across
    entities. records: by entity, as for `answers`; an entity that is missing writes nothing.
    """
    spark = next(iter(records.values())).sparkSession
    none = spark.createDataFrame([], "id string, content_hash string")
    accepted, out = None, None
    for rank, entity in enumerate(e for e in ENTITIES if e in records):
        rows = records[entity].withColumns({"entity": F.lit(entity), "entity_rank": F.lit(rank)})
        rows = limit_per_entity(rows, limit) if limit is not None else rows.withColumn("not_attempted", F.lit(False))
        sent = rows.where("not not_attempted").drop("not_attempted")
        late = rows.where("not_attempted").withColumns({"outcome": F.lit("not_attempted"), "error_type": F.lit(None).cast("string")})
        if entity != "organization" and accepted is not None:
            there = accepted.select(F.col("id").alias("organization_id")).distinct()
            blocked = sent.where("organization_id is not null").join(there, "organization_id", "left_anti").withColumns({"outcome": F.lit("blocked"), "error_type": F.lit("parent_not_in_target")})
            sent = sent.join(there, "organization_id", "left_semi")
        else:
            blocked = None
        told = answers(sent, entity, None if entity == "organization" else accepted, (existing or {}).get(entity, none))
        names = ["entity", "entity_rank", "id", "ord", "outcome", "error_type"]
        all_ = told.select(*names).unionByName(late.select(*names))
        all_ = all_ if blocked is None else all_.unionByName(blocked.select(*names))
        if stop_after is not None:
            cut = _cut(told.where(F.col("outcome").isin("rejected", "failed")), stop_after)
            all_ = all_.join(cut, "entity", "left")
            past = F.coalesce(F.col("ord") > F.col("cut"), F.lit(False))
            all_ = all_.withColumns({"outcome": F.when(past, "not_attempted").otherwise(F.col("outcome")), "error_type": F.when(~past, F.col("error_type"))}).drop("cut")
        all_ = barrier(all_, f"written-{entity}")
        if entity == "organization":
            status = records[entity].select("ord", "status")
            accepted = all_.where("outcome in ('created', 'unchanged')").join(status, "ord").groupBy("id").agg(F.min_by("status", "ord").alias("status"))
            accepted = barrier(accepted, "accepted")
        out = all_ if out is None else out.unionByName(all_)
    past = F.lit(False)
    # Fewer failures than a run needs are no run, wherever they are; only more of them are put into the order.
    trip = None
    if out.where("outcome = 'failed'").count() >= threshold:
        tried = with_runs(out.where("outcome not in ('blocked', 'not_attempted')"))
        trip = tried.where(F.col("run") >= threshold).agg(F.min(F.struct("entity_rank", "ord")).alias("t")).select("t.*").first()
    if trip is not None and trip["ord"] is not None:
        past = (F.col("entity_rank") > trip["entity_rank"]) | ((F.col("entity_rank") == trip["entity_rank"]) & (F.col("ord") > trip["ord"]))
    return out.select("entity", "id", "ord", F.when(past, "not_attempted").otherwise(F.col("outcome")).alias("outcome"), F.when(~past, F.col("error_type")).alias("error_type"))


def draw_faults(records: DataFrame, seed: int, rate: float, max_attempts: int = 4) -> DataFrame:
    """Adds mode, attempts, outcome and landed: a fault is a pure function of (seed, entity, id).

    Each attempt draws anew; a record fails if all its attempts do. Timeouts and malformed answers land all the same.
    """
    unit = lambda *c: F.pmod(F.xxhash64(F.lit(seed), "entity", "id", *c), F.lit(10**6)) / 10**6
    bad = F.transform(F.sequence(F.lit(1), F.lit(max_attempts)), lambda k: F.pmod(F.xxhash64(F.lit(seed), F.col("entity"), F.col("id"), k), F.lit(10**6)) / 10**6 < rate)
    first_good = F.array_position(bad, F.lit(False))
    mode = F.element_at(F.array(*[F.lit(m) for m in ("rate_limited", "server_error", "timeout", "malformed")]), (F.floor(unit(F.lit("mode")) * 4) + 1).cast("int"))
    failed = first_good == 0
    faulty = failed | (first_good > 1)
    return records.withColumns({"mode": F.when(faulty, mode), "attempts": F.when(failed, max_attempts).otherwise(first_good).cast("int"), "outcome": F.when(failed, "failed").otherwise("accepted"), "landed": ~failed | mode.isin("timeout", "malformed")})


class TargetStore:
    """Records by entity and namespace, each a table with versions: appended, never changed, one writer's batch at a time."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def table(self, entity: str, namespace: str) -> Store:
        return Store(self.spark, f"{self.root}/{entity}/{namespace}")

    def read(self, entity: str, namespace: str) -> DataFrame:
        return self.table(entity, namespace).read(schema="id string, content_hash string, payload string").withColumn("namespace", F.lit(namespace))

    def write(self, entity: str, namespace: str, drafts: DataFrame) -> DataFrame:
        """Appends what is new and returns every record's outcome. Refused with a Conflict if others have written meanwhile."""
        table = self.table(entity, namespace)
        base = table.version().number
        place = F.col("ord" if "ord" in drafts.columns else "source_row").alias("ord")
        rows = drafts.select(F.col("record_id").alias("id"), content_hash().alias("content_hash"), F.to_json("payload").alias("payload"), place)
        found = barrier(classify_writes(rows, self.read(entity, namespace)), f"write-{entity}")
        table.append(found.where("outcome = 'created'").select("id", "content_hash", "payload"), base)
        return found

    def purge(self, entity: str, namespace: str) -> int:
        """Removes a rehearsal's namespace; the live one is refused."""
        if namespace == LIVE_NAMESPACE:
            raise ValueError("the live namespace is never purged")
        table = self.table(entity, namespace)
        version = table.version()
        if version.number:
            table.clear(version.number)
            table.vacuum()
        return version.rows
