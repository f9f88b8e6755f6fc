"""A migration from exports to a report, one call per step; every step is a frame that can be looked at."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.operators import compare, profile, readiness, reconcile, report, validate, write
from quayside.plans.config import Config
from quayside.plans.contract import catalog
from quayside.plans.drafts import DatasetPlan, compile_drafts, live
from quayside.plans.shared import barrier


@dataclass(frozen=True)
class Rehearsal:
    """What a dry run did: an outcome per valid record, and every record with its first error and outcome."""

    outcomes: DataFrame
    records: DataFrame


@dataclass
class Project:
    """Exports by name, an approved plan for each, and a configuration."""

    exports: dict[str, DataFrame]
    plans: dict[str, DatasetPlan]
    config: Config
    row_idx: str = "row_idx"
    rules: list = field(default_factory=list)  # functions of all drafts by entity

    def profile(self, name: str) -> DataFrame:
        return profile.profile_table(profile.value_table(self.exports[name], self.row_idx))

    def issues(self, name: str) -> DataFrame:
        return profile.quality_issues(self.exports[name], self.config.as_of, self.row_idx)

    def compare(self, fields: DataFrame, facts: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(classes, candidates) of fields (dataset, source_field) with what is known of their values."""
        targets = catalog(fields.sparkSession)
        found = barrier(compare.judged(compare.candidates(fields, targets), facts, targets), "candidates")
        return compare.classify(found, fields), found

    def drafts(self) -> dict[str, DataFrame]:
        """Drafts by entity, from all exports that emit it, after the project's rules."""
        out: dict[str, DataFrame] = {}
        for rank, (name, plan) in enumerate(self.plans.items()):
            for entity in plan.emits():
                # Raw and context columns differ between exports of one entity.
                own = compile_drafts(self.exports[name], plan, entity, self.config, self.row_idx, rank)
                out[entity] = own if entity not in out else out[entity].unionByName(own, allowMissingColumns=True)
        out = {e: barrier(d, f"drafts-{e}") for e, d in out.items()}
        for rule in self.rules:
            out = rule(out)
        return out

    def validate(self, drafts: dict[str, DataFrame], as_of: dict[str, str] | str | None = None) -> dict[str, DataFrame]:
        checked = validate.validate(drafts, as_of or self.config.as_of)
        return {e: barrier(d, f"validated-{e}") for e, d in checked.items()}

    def dry_run(self, validated: dict[str, DataFrame], fault=None, **options) -> Rehearsal:
        """Writes all valid drafts into an empty namespace, entity by entity; options as for `write.dry_run`.

        fault: a condition on a draft under which the target fails it, for rehearsals of an outage.
        """
        sent = {e: writes_of(d, e, fault) for e, d in validated.items()}
        outcomes = barrier(write.dry_run(sent, **options), "outcomes")
        every = None
        for entity, d in validated.items():
            first = F.get(F.filter("issues", lambda x: x["severity"] == "error"), F.lit(0))["error_type"]
            rows = d.select(F.lit(entity).alias("entity"), F.col("record_id").alias("id"), "skipped", F.when(~F.col("skipped"), first).alias("first_error"), "ord")
            every = rows if every is None else every.unionByName(rows)
        told = outcomes.select("entity", "ord", F.when(F.col("outcome").isin("created", "unchanged"), "accepted").otherwise(F.col("outcome")).alias("outcome"))
        return Rehearsal(outcomes, barrier(every.join(told, ["entity", "ord"], "left").drop("ord"), "records"))

    def reconcile(self, run: Rehearsal, held: DataFrame, unreadable: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
        """(checks, discrepancies) of a run against what the target holds (entity, id)."""
        r = run.records
        off = barrier(reconcile.id_difference(r.where("outcome = 'accepted'"), held, r.where("outcome in ('failed', 'rejected')")), "difference")
        found = barrier(reconcile.checks(reconcile.ledger(r), held, off, unreadable), "checks")
        return found, reconcile.discrepancies(found, off)

    def report(self, title: str, validated: dict[str, DataFrame], run: Rehearsal, checks: DataFrame) -> str:
        issues = None
        for d in validated.values():
            own = validate.issues_of(d)
            issues = own if issues is None else issues.unionByName(own)
        issues = barrier(issues, "issues")
        covered = reconcile.coverage(reconcile.ledger(run.records))
        gates = readiness.gates(covered, checks, issues.where("severity = 'warning'").limit(1).count())
        notes = None
        for d in validated.values():
            notes = d.select("notes") if notes is None else notes.unionByName(d.select("notes"))
        return report.render(title, gates, covered, readiness.work_items(readiness.issue_groups(issues)), checks, readiness.normalization_counts(notes))


def writes_of(drafts: DataFrame, entity: str, fault=None) -> DataFrame:
    """The valid drafts as `write.dry_run` takes them."""
    p = lambda name: F.col(f"payload.{name}")
    read = {
        "organization": {"status": "lifecycle_status"},
        "contact": {"organization_id": "organization_id", "is_primary": "is_primary", "email": "email"},
        "subscription": {"organization_id": "organization_id", "status": "status"},
        "activity": {"organization_id": "organization_id"},
    }[entity]
    more = {name: p(source) == "true" if name == "is_primary" else p(source) for name, source in read.items()}
    down = F.lit(False) if fault is None else F.coalesce(fault, F.lit(False))
    named = [c.alias(n) for n, c in more.items()]
    return drafts.where(live()).select(F.col("record_id").alias("id"), "ord", write.content_hash().alias("content_hash"), down.alias("fault"), *named)
