"""Transformation plans compiled into columns: one record draft per source row, no shuffle."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.functions.converters import names_of, stage_chains
from quayside.plans.config import Config
from quayside.plans.contract import CONTRACT, ENTITIES, entity_fields, id_field
from quayside.plans.shared import spread

ISSUE = "struct<error_type:string,severity:string,field:string,value:string,message:string,rule:string>"


@dataclass(frozen=True)
class FieldRule:
    source: str
    target: str


@dataclass(frozen=True)
class DatasetPlan:
    """Approved fields of a dataset. It emits an entity only if that entity's id is among the targets."""

    dataset: str
    rules: tuple[FieldRule, ...]
    keep_raw: tuple[str, ...] = ()

    def emits(self) -> tuple[str, ...]:
        targets = {r.target for r in self.rules}
        return tuple(e for e in ENTITIES if f"{e}.{id_field(e)}" in targets)

    def split(self, entity: str) -> tuple[list[FieldRule], list[FieldRule]]:
        """The entity's own fields, and those that only give context."""
        own = [r for r in self.rules if r.target.startswith(f"{entity}.")]
        return own, [r for r in self.rules if r not in own]


def emissions(mappings: DataFrame) -> DataFrame:
    """(dataset, entity) from mappings (dataset, target, status): a dataset emits an entity whose id is among its approved targets."""
    entity = F.create_map(*[F.lit(x) for e in ENTITIES for x in (f"{e}.{id_field(e)}", e)])
    named = mappings.where("status = 'approved'").select("dataset", F.element_at(entity, F.col("target")).alias("entity"))
    return named.where("entity is not null").distinct()


class UndecidedFields(ValueError):
    pass


def build_plan(dataset: str, mappings: list[tuple[str, str | None, str]], keep_raw: tuple[str, ...] = ()) -> DatasetPlan:
    """From (source field, target, status) in column order; refuses while a field is undecided."""
    open_ = [s for s, _, status in mappings if status not in ("approved", "rejected", "ignored")]
    if open_:
        raise UndecidedFields(f"{dataset}: undecided fields {open_}")
    rules = tuple(FieldRule(s, t) for s, t, status in mappings if status == "approved" and t)
    for r in rules:
        if r.target not in CONTRACT:
            raise ValueError(f"unknown target {r.target!r}")
    return DatasetPlan(dataset, rules, keep_raw)


def issue(error_type: str | Column, severity: str, field: str | None, value: Column | None, message: Column | str, rule: str | None = None) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x).cast("string")
    return F.struct(lit(error_type).alias("error_type"), lit(severity).alias("severity"), lit(field).alias("field"), F.substring(lit(value), 1, 200).alias("value"), lit(message).alias("message"), lit(rule).alias("rule"))


def with_issue(drafts: DataFrame, when: Column, one: Column) -> DataFrame:
    return drafts.withColumn("issues", F.when(when, F.concat("issues", F.array(one))).otherwise(F.col("issues")))


def has_errors() -> Column:
    return F.exists("issues", lambda x: x["severity"] == "error")


def live() -> Column:
    return ~F.col("skipped") & ~has_errors()


#: Rows of one export come before those of the next.
DATASET_BITS = 40


def compile_drafts(df: DataFrame, plan: DatasetPlan, entity: str, config: Config, row_idx: str = "row_idx", rank: int = 0) -> DataFrame:
    """(entity, dataset, source_row, ord, record_id, payload, raw, context, notes, applied_rules, issues, skipped, skip_reason, skip_rule).

    Where two columns have one target, the later one that says something wins. Notes and issues keep the order of the
    columns; the first error is the first of them. rank is the export's place among the plans: ord, by rank and then by
    row, is the order in which drafts of an entity count everywhere.
    """
    own, context = plan.split(entity)
    rules = [*own, *context]
    staged = stage_chains(spread(df), {f"_r{i}": (r.source, config.chain(r.target), config.context(r.target)) for i, r in enumerate(rules)})
    at = {r: F.col(f"_r{i}") for i, r in enumerate(rules)}

    def of(target: str, among: list[FieldRule]) -> Column:
        found = []
        for r in among:
            value = at[r]["value"]
            split = r.target == "contact.first_name" and "person_name_split" in config.chain(r.target)
            first, last = names_of(value)
            if r.target == target:
                found.append(first if split else value)
            elif split and target == "contact.last_name":
                found.append(last)
        return F.coalesce(*reversed(found)) if found else F.lit(None).cast("string")

    payload = F.struct(*[of(f"{entity}.{name}", own).alias(name) for name in entity_fields(entity)])
    contexts = F.struct(*[of(t, context).alias(t.replace(".", "_")) for t in dict.fromkeys(r.target for r in context)]) if context else F.lit(None).cast("struct<none:string>")
    raw = F.struct(*[F.col(c).cast("string").alias(c) for c in plan.keep_raw]) if plan.keep_raw else F.lit(None).cast("struct<none:string>")
    notes = F.filter(F.array(*[at[r]["note"] for r in own]), lambda x: x.isNotNull())
    errors = F.filter(F.array(*[F.when(at[r]["error_type"].isNotNull(), issue(at[r]["error_type"], "error", r.target.split(".", 1)[1], F.col(r.source).cast("string"), F.concat(F.lit(f"{r.source}: "), at[r]["error"]))) for r in own]), lambda x: x.isNotNull())
    out = staged.select(F.lit(entity).alias("entity"), F.lit(plan.dataset).alias("dataset"), F.col(row_idx).cast("long").alias("source_row"), (F.lit(rank << DATASET_BITS) + F.col(row_idx).cast("long")).alias("ord"), payload.alias("payload"), raw.alias("raw"), contexts.alias("context"), notes.alias("notes"), F.array().cast("array<string>").alias("applied_rules"), errors.cast(f"array<{ISSUE}>").alias("issues"))
    record_id = F.col(f"payload.{id_field(entity)}")
    out = out.withColumn("record_id", record_id).withColumns({"skipped": F.lit(False), "skip_reason": F.lit(None).cast("string"), "skip_rule": F.lit(None).cast("string")})
    return with_issue(out, record_id.isNull(), issue("missing_identifier", "error", id_field(entity), None, f"{id_field(entity)} is empty"))
