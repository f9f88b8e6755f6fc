"""Readiness: groups of issues, gates with a verdict, work items and counts of normalizations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quayside.functions.texts import numbers_in
from quayside.plans.stores import Store, Version

# What each kind of issue asks for; anything else is for review.
ACTIONS = {
    "unmapped_value": "decision", "undecidable_plan": "decision", "business_rule_violation": "decision", "plan_conflicts_with_tier": "decision", "ambiguous_country": "decision",
    "missing_identifier": "data_fix", "missing_required": "data_fix", "duplicate_identifier": "data_fix", "malformed_email": "data_fix", "unparseable_number": "data_fix", "unparseable_date": "data_fix", "missing_relationship": "data_fix", "duplicate_contact_email": "data_fix", "incomplete_name": "data_fix", "phone_too_short": "data_fix", "out_of_range": "data_fix", "invalid_value": "data_fix",
    "parent_record_rejected": "dependent",
}


def issue_groups(issues: DataFrame, fields: int = 4) -> DataFrame:
    """Per (entity, severity, error_type): issues, distinct records and the commonest fields."""
    key = ["entity", "severity", "error_type"]
    by_field = issues.groupBy(*key, "field").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("n"), "field"))
    top = by_field.withColumn("r", rank).where(F.col("r") <= fields).groupBy(*key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "field"))), lambda x: x["field"]), ",").alias("fields"))
    n = issues.groupBy(*key).agg(F.count("*").alias("issues"), F.countDistinct("dataset", "source_row").alias("records"))
    return n.join(top, key).select(*key, "issues", "records", "fields")


def gates(coverage: DataFrame, checks: DataFrame, warnings: int, floor: float = 0.95) -> DataFrame:
    """(gate, state): BLOCKER, CONDITION or PASS, and the verdict they make.

    Coverage is judged by its counts, never by a rounded share: a single record that stays behind is a condition. Without
    any check nothing is reconciled, which blocks.
    """
    share = F.when(F.col("in_scope") > 0, F.col("accepted") / F.col("in_scope")).otherwise(1.0)
    landed = F.when(share < floor, "BLOCKER").when(F.col("in_scope") > F.col("accepted"), "CONDITION").otherwise("PASS")
    rows = coverage.select(F.concat(F.lit("coverage:"), F.col("entity")).alias("gate"), landed.alias("state"))
    balanced = checks.agg(F.coalesce(F.min(F.col("ok").cast("int")), F.lit(0)).alias("ok"))
    balanced = balanced.select(F.lit("reconciliation").alias("gate"), F.when(F.col("ok") == 1, "PASS").otherwise("BLOCKER").alias("state"))
    warned = checks.sparkSession.range(1).select(F.lit("warnings").alias("gate"), F.lit("CONDITION" if warnings else "PASS").alias("state"))
    return verdict(rows.union(balanced).union(warned))


def _gate(df: DataFrame, name: str, blocked) -> DataFrame:
    return df.select(F.lit(name).alias("gate"), F.when(blocked, "BLOCKER").otherwise("PASS").alias("state"))


def decision_gate(mappings: DataFrame, questions: DataFrame) -> DataFrame:
    """mappings_decided: every field approved, rejected or ignored, and no question open. questions: one row each, with `open`."""
    undecided = mappings.agg(F.count_if(~F.coalesce(F.col("status").isin("approved", "rejected", "ignored"), F.lit(False))).alias("undecided"))
    return _gate(undecided.crossJoin(questions.agg(F.count_if("open").alias("n_open"))), "mappings_decided", (F.col("undecided") > 0) | (F.col("n_open") > 0))


def rehearsal_gates(run: DataFrame, plan: str, config: str) -> DataFrame:
    """rehearsal, rehearsal_current and target_accepted of the latest run (partial, plan, config, rejected, failed).

    No row: not rehearsed, which blocks and leaves nothing else to judge.
    """
    none = run.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("rehearsal").alias("gate"), F.lit("BLOCKER").alias("state"))
    stale = ~(F.col("plan").eqNullSafe(F.lit(plan)) & F.col("config").eqNullSafe(F.lit(config)))
    refused = F.coalesce("rejected", F.lit(0)) + F.coalesce("failed", F.lit(0)) > 0
    return none.union(_gate(run, "rehearsal", F.coalesce("partial", F.lit(False)))).union(_gate(run, "rehearsal_current", stale)).union(_gate(run, "target_accepted", refused))


def verdict(states: DataFrame) -> DataFrame:
    """states (gate, state) and the verdict they make: any blocker blocks, any condition is one."""
    worst = states.agg(F.max(F.when(F.col("state") == "BLOCKER", 2).when(F.col("state") == "CONDITION", 1).otherwise(0)).alias("v"))
    return states.union(worst.select(F.lit("verdict").alias("gate"), F.when(F.col("v") == 2, "BLOCKED").when(F.col("v") == 1, "READY WITH CONDITIONS").otherwise("READY").alias("state")))


def issue_counts(issues: DataFrame) -> DataFrame:
    """(severity, error_type, n), and with a null error_type the sum of a severity."""
    return issues.rollup("severity", "error_type").agg(F.count("*").alias("n")).where("severity is not null")


def issue_breakdown(issues: DataFrame, examples: int = 3) -> DataFrame:
    """Per (entity, error_type, field): issues, distinct records and the first rows where it occurs."""
    key = ["entity", "error_type", "field"]
    nth = F.row_number().over(Window.partitionBy(*key).orderBy("source_row", "dataset"))
    # Equal places tie by dataset; each task sends `examples` of a group at most.
    few = issues.select(*key, "source_row", "dataset").distinct().withColumn("nth", nth).where(F.col("nth") <= examples)
    few = few.groupBy(*key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("source_row", "dataset"))), lambda x: F.concat_ws(":", x["dataset"], x["source_row"].cast("string"))), ",").alias("examples"))
    n = issues.groupBy(*key).agg(F.count("*").alias("issues"), F.countDistinct("dataset", "source_row").alias("records"))
    same = [n[k].eqNullSafe(few[k]) for k in key]
    return n.join(few, same).select(*[n[k] for k in key], "issues", "records", "examples")


#: Characters that a stored issue keeps of its texts.
KEPT_TEXT = {"message": 2000, "value": 300, "rule": 200}
_ISSUE_ORDER = ["entity", "dataset", "source_row", "error_type", "field"]


def store_issues(store: Store, issues: DataFrame, base: int, limit: int | None = None, **note) -> Version:
    """A version of a run's issues, errors first, then warnings; where a limit cuts them, the version says so."""
    texts = {c: F.substring(c, 1, n) for c, n in KEPT_TEXT.items() if c in issues.columns}
    rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return store.replace(issues.withColumns(texts), base, [rank, *_ISSUE_ORDER], ("entity", "severity", "error_type"), limit, **note)


def store_failures(store: Store, failures: DataFrame, base: int, limit: int | None = None, **note) -> Version:
    """A version of what a run could not write (entity, id, error_type and more), by entity and id."""
    return store.replace(failures, base, ["entity", "id"], ("entity", "error_type"), limit, **note)


def store_mappings(store: Store, mappings: DataFrame, base: int, **note) -> Version:
    """A version of mappings (dataset, position, source_field, status and more), as the exports have their columns."""
    return store.replace(mappings, base, ["dataset", "position", "source_field"], ("dataset", "status"), **note)


def rule_counts(drafts: DataFrame) -> DataFrame:
    """(rule, n): how often each rule was applied, and how many records it keeps back; what follows a colon in an applied rule tells of a single draft."""
    applied = drafts.select(F.explode("applied_rules").alias("rule")).select(F.split_part("rule", F.lit(":"), F.lit(1)).alias("rule"))
    if "skip_rule" in drafts.columns:
        kept_back = drafts.where(F.col("skipped") & F.col("skip_rule").isNotNull())
        applied = applied.unionByName(kept_back.select(F.concat("skip_rule", F.lit(": records not migrated")).alias("rule")))
    return applied.groupBy("rule").agg(F.count("*").alias("n"))


def issue_overview(issues: DataFrame, fields: int = 5) -> DataFrame:
    """(entity, severity, error_type, count, fields): counts and the commonest fields that are named, most issues first."""
    key = ["entity", "severity", "error_type"]
    by_field = issues.where("field is not null").groupBy(*key, "field").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("n"), "field"))
    top = by_field.withColumn("r", rank).where(F.col("r") <= fields).groupBy(*key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "field"))), lambda x: x["field"]), ",").alias("fields"))
    n = issues.groupBy(*key).agg(F.count("*").alias("count"))
    same = [n[k].eqNullSafe(top[k]) for k in key]
    return n.join(top, same, "left").select(*[n[k] for k in key], "count", F.coalesce("fields", F.lit("")).alias("fields")).orderBy(F.desc("count"), *key)


def work_items(groups: DataFrame) -> DataFrame:
    """(entity, error_type, kind, blocking, records): what somebody has to decide, fix or look at."""
    kind = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ACTIONS.items() for x in kv]), F.col("error_type")), F.lit("review"))
    return groups.select("entity", "error_type", kind.alias("kind"), (F.col("severity") == "error").alias("blocking"), "records").orderBy(F.desc("blocking"), "kind", F.desc("records"), "entity", "error_type")


def normalization_counts(drafts: DataFrame, keep: int = 25) -> DataFrame:
    """The commonest notes, quoted values masked."""
    notes = drafts.select(F.explode("notes").alias("note")).select(F.explode(F.split("note", "; ")).alias("note"))
    masked = notes.select(F.regexp_replace("note", r"'[^']*'", "'...'").alias("note")).groupBy("note").agg(F.count("*").alias("n"))
    return masked.orderBy(F.desc("n"), "note").limit(keep)


def unfounded_numbers(texts: DataFrame, facts: DataFrame) -> DataFrame:
    """(part, number): numbers in texts (part, text) that no fact (text) has, as when a summary makes one up."""
    said = texts.select("part", F.explode(numbers_in(F.col("text"))).alias("number")).distinct()
    known = facts.select(F.explode(numbers_in(F.col("text"))).alias("number")).distinct()
    return said.join(known, "number", "left_anti").select("part", "number")


def next_steps(states: DataFrame, work: DataFrame, open_questions: int) -> DataFrame:
    """(place, step, records): what to do next, from gates (gate, state) and work items (kind, records)."""
    blocked = states.where("state = 'BLOCKER'").select("gate")
    one = states.agg(F.max(F.when(F.col("gate") == "verdict", F.col("state"))).alias("verdict"), F.max(F.when(F.col("state") == "CONDITION", 1).otherwise(0)).alias("conditions"))
    kinds = work.agg(
        *[F.count_if(F.col("kind") == k).alias(k) for k in ("decision", "data_fix", "review")], *[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("records"))), F.lit(0)).alias(f"{k}_records") for k in ("data_fix", "dependent")]
    )
    gates_ = blocked.agg(F.collect_set("gate").alias("gates"))  # a handful of gates
    f = one.crossJoin(kinds).crossJoin(gates_)
    has = lambda *names: F.arrays_overlap("gates", F.array(*map(F.lit, names)))
    asks = F.col("decision") + F.lit(open_questions)
    steps = [
        ("decide the open fields and questions", has("mappings_decided"), None),
        ("rehearse the whole current plan", has("rehearsal", "rehearsal_current"), None),
        ("explain what does not reconcile", has("reconciliation"), None),
        ("look into what the target refused", has("target_accepted"), None),
        ("ask the customer", asks > 0, asks),
        ("have data corrected", F.col("data_fix") > 0, F.col("data_fix_records")),
        ("expect dependent records after that", F.col("dependent_records") > 0, F.col("dependent_records")),
        ("rehearse the corrected export", (F.col("decision") > 0) | (F.col("data_fix") > 0), None),
        ("get the sign-off on what stays behind", (F.col("verdict") != "BLOCKED") & ((F.col("review") > 0) | (F.col("conditions") > 0)), None),
        ("agree on a date", F.col("verdict") != "BLOCKED", None),
    ]
    rows = [F.when(when, F.struct(F.lit(i).alias("place"), F.lit(text).alias("step"), (F.lit(None) if n is None else n).cast("long").alias("records"))) for i, (text, when, n) in enumerate(steps)]
    return f.select(F.explode(F.array_compact(F.array(*rows))).alias("s")).select("s.*")


def latest(runs: DataFrame, *by: str) -> DataFrame:
    """The newest run of each kind, by started_at, ties by id: one row a group, without sorting any."""
    names = [c for c in runs.columns if c not in by]
    return runs.groupBy(*by).agg(F.max_by(F.struct(*names), F.struct("started_at", "id")).alias("r")).select(*by, "r.*")


def stalled(runs: DataFrame, now: str, seconds: int = 600) -> DataFrame:
    """Running ones that gave no sign of life for so long."""
    last = F.coalesce("heartbeat_at", "started_at")
    return runs.where((F.col("status") == "running") & (last < F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {seconds} SECONDS")))
