"""Record rules and cross-dataset rules over drafts. Each is DataFrame -> DataFrame; RULES names them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.functions.converters import lookup_key, stage_chains
from quayside.plans.config import Config
from quayside.plans.drafts import issue, with_issue

# Fixed values.
PROVINCES = ["AB", "BC", "MB", "NB", "NL", "NS", "NT", "NU", "ON", "PE", "QC", "SK", "YT"]

RULES: dict[str, Callable[..., DataFrame]] = {}


def rule(name: str):
    def register(fn):
        RULES[name] = fn
        return fn

    return register


def _set(drafts: DataFrame, field: str, when: Column, value: Column | str, applied: str | None = None) -> DataFrame:
    new = value if isinstance(value, Column) else F.lit(value)
    out = drafts.withColumn("payload", F.col("payload").withField(field, F.when(when, new).otherwise(F.col(f"payload.{field}"))))
    return _applied(out, when, applied) if applied else out


def _applied(drafts: DataFrame, when: Column, text: str) -> DataFrame:
    return drafts.withColumn("applied_rules", F.when(when, F.concat("applied_rules", F.array(F.lit(text)))).otherwise(F.col("applied_rules")))


def _frozen(drafts: DataFrame, when: Column) -> tuple[DataFrame, Column]:
    """The condition as a column of its own, so that later changes to the draft do not change it."""
    return drafts.withColumn("_when", F.coalesce(when, F.lit(False))), F.col("_when")


@rule("ca_country_from_region")
def ca_country_from_region(drafts: DataFrame, config: Config, column: str = "country") -> DataFrame:
    """A raw country of CA is Canada with a province, the US with another region, and doubtful with none."""
    region = F.col("payload.billing_region")
    drafts, ca = _frozen(drafts, lookup_key(F.col(f"raw.{column}")) == "ca")
    province = region.isin(PROVINCES)
    out = with_issue(drafts, ca & region.isNull(), issue("ambiguous_country", "warning", "billing_country", F.col(f"raw.{column}"), "CA without a region may be Canada or California"))
    out = _applied(out, ca & region.isNotNull(), "ca_country_from_region")
    return _set(out, "billing_country", ca & region.isNotNull() & ~province, "US").drop("_when")


@rule("dormant_account_inactive")
def dormant_account_inactive(drafts: DataFrame, config: Config, months: int = 18, column: str = "last_activity_date") -> DataFrame:
    """An active or prospect account without activity for so many months becomes inactive."""
    raw = drafts.withColumn("_raw", F.col(f"raw.{column}"))
    drafts = stage_chains(raw, {"_seen": ("_raw", ("blank_to_null", "date"), config.context("organization.customer_since"))}).drop("_raw")
    seen = F.col("_seen.value").try_cast("date")
    stale = seen < F.add_months(F.lit(config.as_of).cast("date"), -months)
    drafts, when = _frozen(drafts, stale & F.col("payload.lifecycle_status").isin("active", "prospect"))
    return _set(drafts, "lifecycle_status", when, "inactive", "dormant_account_inactive").drop("_when", "_seen")


@rule("legacy_gold_seat_split")
def legacy_gold_seat_split(drafts: DataFrame, config: Config, alias: str = "legacy gold", min_seats: int = 10, small_plan: str = "professional", column: str = "subscription_level") -> DataFrame:
    """The alias is the small plan under so many seats; without seats nobody can tell."""
    drafts, gold = _frozen(drafts, lookup_key(F.col(f"raw.{column}")) == alias)
    seats = F.col("payload.seats").try_cast("long")
    out = with_issue(drafts, gold & seats.isNull(), issue("undecidable_plan", "error", "plan", F.col(f"raw.{column}"), f"{alias} needs a number of seats"))
    return _set(out, "plan", gold & (seats < min_seats), small_plan, "legacy_gold_seat_split").drop("_when")


@rule("drop_dead_trials")
def drop_dead_trials(drafts: DataFrame, config: Config, max_age_days: int = 90) -> DataFrame:
    """Trials that began longer ago are skipped."""
    age = F.datediff(F.lit(config.as_of).cast("date"), F.col("payload.start_date").try_cast("date"))
    dead = F.coalesce((F.col("payload.status") == "trial") & (age > max_age_days), F.lit(False))
    return drafts.withColumns({
        "skipped": F.col("skipped") | dead,
        "skip_reason": F.when(dead, F.concat(F.lit("trial of "), age.cast("string"), F.lit(" days"))).otherwise(F.col("skip_reason")),
        "skip_rule": F.when(dead, "drop_dead_trials").otherwise(F.col("skip_rule")),
    })


def primary_from_account_email(contacts: DataFrame, organizations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The contact with the account's own address becomes primary where no contact is; (contacts, organizations).

    Per organization that is not skipped, has an id and gives an address: with no contacts, or none of that address, it
    gets a warning. One aggregate over contacts and two joins on the organization id.
    """
    email = F.lower(F.col("context.contact_email"))
    asked = organizations.where(~F.col("skipped") & F.col("record_id").isNotNull() & email.isNotNull()).select(F.col("record_id").alias("org"), email.alias("email"), F.col("ord").alias("org_ord"))
    own = contacts.where(~F.col("skipped")).select(F.col("payload.organization_id").alias("org"), F.lower("payload.email").alias("mail"), "ord", (F.col("payload.is_primary") == "true").alias("is_primary")).where("org is not null")
    per_org = own.groupBy("org").agg(F.max(F.coalesce("is_primary", F.lit(False)).cast("int")).alias("has_primary"))
    state = asked.join(per_org, "org", "left")
    wanted = state.where("has_primary = 0").join(own, "org").where(F.col("mail") == F.col("email"))
    chosen = wanted.groupBy("org", "org_ord").agg(F.min("ord").alias("ord"))
    picked = chosen.select("ord").distinct().withColumn("_pick", F.lit(True))
    new_contacts = contacts.join(picked, "ord", "left").withColumn("_pick", F.coalesce("_pick", F.lit(False)))
    new_contacts = _set(new_contacts, "is_primary", F.col("_pick"), "true", "primary_from_account_email").drop("_pick").select(contacts.columns)
    verdict = state.join(chosen.select("org", "org_ord", F.lit(True).alias("found")), ["org", "org_ord"], "left")
    kind = F.when(F.col("has_primary").isNull(), "primary_contact_missing").when((F.col("has_primary") == 0) & F.col("found").isNull(), "primary_contact_not_found")
    verdict = verdict.select(F.col("org_ord").alias("ord"), kind.alias("_kind")).where("_kind is not null")
    new_orgs = organizations.join(verdict, "ord", "left")
    new_orgs = with_issue(new_orgs, F.col("_kind").isNotNull(), issue(F.col("_kind"), "warning", "primary_contact", email, "no contact for the account's own address")).select(organizations.columns)
    return new_contacts, new_orgs
