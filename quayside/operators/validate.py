"""Validation: the contract, then checks over whole batches, in a fixed order.

Each check looks at drafts still without an error. Children are joined to one row per organization id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.functions.converters import ADDRESS
from quayside.plans.contract import ENTITIES, entity_fields, id_field
from quayside.plans.drafts import has_errors, issue, live, with_issue
from quayside.plans.shared import Stages


def _field_issue(name: str, spec) -> Column:
    """The first thing wrong with a field, or null."""
    v = F.col(f"payload.{name}")
    bad = lambda kind, message: issue(kind, "error", name, v, f"{name}: {message}")
    out = F.lit(None)
    checks: list[tuple[Column, Column]] = []
    if spec.required:
        checks.append((v.isNull(), bad("missing_required", "field required")))
    if spec.kind == "enum":
        checks.append((~v.isin(list(spec.enum)), bad("invalid_enum_value", "not in the closed list")))
    if spec.min_length:
        checks.append((F.length(v) < spec.min_length, bad("invalid_format", "too short")))
    if spec.max_length and spec.kind != "list":
        checks.append((F.length(v) > spec.max_length, bad("value_too_long", f"longer than {spec.max_length}")))
    if spec.pattern:
        checks.append((~v.rlike(spec.pattern), bad("invalid_format", "does not match the pattern")))
    if spec.kind in ("integer", "decimal"):
        number = v.try_cast("decimal(38,4)")
        checks.append((v.isNotNull() & number.isNull(), bad("invalid_number", "not a number")))
        if spec.minimum is not None:
            checks.append((number < spec.minimum, bad("out_of_range", f"less than {spec.minimum}")))
        if spec.kind == "decimal":
            checks.append((F.abs(number) >= 10**13, bad("invalid_number", "more than 15 digits")))
    if spec.kind == "date":
        checks.append((v.isNotNull() & v.try_cast("date").isNull(), bad("invalid_date", "not a date")))
    if spec.kind == "datetime":
        checks.append((v.isNotNull() & v.try_cast("timestamp").isNull(), bad("invalid_date", "not a time")))
    if spec.kind == "boolean":
        checks.append((~v.isin("true", "false"), bad("invalid_boolean", "not a boolean")))
    if spec.kind == "url":
        checks.append((~v.rlike(r"(?i)^https?://[^\s/]+"), bad("invalid_format", "not a url")))
    if spec.kind == "email":
        checks.append((~v.rlike(ADDRESS), bad("invalid_value", "not an address")))
    if spec.kind == "list" and spec.max_length:
        checks.append((F.size(F.split(v, r"\|")) > spec.max_length, bad("value_too_long", f"more than {spec.max_length} items")))
    for when, one in reversed(checks):
        out = F.when(when, one).otherwise(out)
    return out


def check_contract(drafts: DataFrame, entity: str) -> DataFrame:
    """Field limits, then limits between fields; skipped drafts are left alone."""
    found = [_field_issue(name, spec) for name, spec in entity_fields(entity).items()]
    if entity == "subscription":
        start, end = (F.col(f"payload.{c}").try_cast("date") for c in ("start_date", "renewal_date"))
        found.append(F.when(end <= start, issue("invalid_value", "error", "renewal_date", F.col("payload.renewal_date"), "renewal_date is not after start_date")))
    more = F.filter(F.array(*found), lambda x: x.isNotNull())
    return drafts.withColumn("issues", F.when(F.col("skipped"), F.col("issues")).otherwise(F.concat("issues", more)))


def _matched(drafts: DataFrame, among: Column, state: DataFrame, on: dict[str, Column]) -> DataFrame:
    """drafts with the columns of `state` where `among` holds; the others, null and dead keys with them, never meet in a join.

    state has one row per key, so a key of very many drafts is split wherever Spark has to shuffle.
    """
    asked = drafts.where(among).join(state, [key == state[name] for name, key in on.items()], "left").drop(*[state[name] for name in on])
    return asked.unionByName(drafts.where(~F.coalesce(among, F.lit(False))), allowMissingColumns=True)


def _place() -> Column:
    """Drafts of an entity in the order in which they count: export by export, then by row."""
    return F.struct("ord", "dataset", "source_row")


def check_unique_ids(drafts: DataFrame, entity: str) -> DataFrame:
    """Among live drafts the first of an id stands; later ones name it."""
    alive = live() & F.col("record_id").isNotNull()
    firsts = drafts.where(alive).groupBy(F.col("record_id").alias("_id")).agg(F.min(_place()).alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    out = _matched(drafts, alive, firsts, {"_id": F.col("record_id")})
    message = F.concat(F.lit(f"{id_field(entity)} "), F.col("record_id"), F.lit(" already appears in "), F.col("_first.dataset"), F.lit(" row "), F.col("_first.source_row").cast("string"))
    again = F.coalesce(_place() > F.col("_first"), F.lit(False))
    return with_issue(out, again, issue("duplicate_identifier", "error", id_field(entity), F.col("record_id"), message)).drop("_first")


def organization_state(organizations: DataFrame) -> DataFrame:
    """One row per id: whether a draft of it migrates, why the last refused one does not, and the last status stated.

    A draft whose status is empty or was refused states none; the draft before it in the order then counts.
    """
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform(F.filter("issues", lambda x: x["severity"] == "error"), lambda x: x["error_type"]))), ", ")
    reason = F.when(kinds == "", "skipped").otherwise(kinds)
    rows = organizations.where(F.col("record_id").isNotNull()).select(F.col("record_id").alias("org"), "ord", live().alias("fine"), reason.alias("reason"), "skipped", F.col("payload.lifecycle_status").alias("status"), F.exists("applied_rules", lambda x: x.startswith("dormant_account_inactive")).alias("by_rule"))
    last = F.when(~F.col("fine"), F.col("ord"))
    kept = F.when(~F.col("skipped") & F.col("status").isNotNull(), F.col("ord"))
    return rows.groupBy("org").agg(F.max(F.col("fine").cast("int")).alias("migrating"), F.max_by("reason", last).alias("reason"), F.max_by("status", kept).alias("status"), F.max_by("by_rule", kept).alias("by_rule"))


def check_parents(children: DataFrame, state: DataFrame) -> DataFrame:
    """A child whose organization does not migrate is refused: the account is refused, or not there at all."""
    own = state.select("org", F.lit(True).alias("_held"), "migrating", "reason")
    asked = live() & F.col("payload.organization_id").isNotNull()
    out = _matched(children, asked, own, {"org": F.col("payload.organization_id")})
    lost = asked & (F.coalesce("migrating", F.lit(0)) == 0)
    held = F.col("_held").isNotNull()
    message = F.when(held, F.concat(F.lit("the organization cannot migrate: "), F.col("reason"))).otherwise(F.lit("the organization is not in the export"))
    return with_issue(out, lost, issue(F.when(held, "parent_record_rejected").otherwise("missing_relationship"), "error", "organization_id", F.col("payload.organization_id"), message)).select(children.columns)


def check_contacts(contacts: DataFrame) -> DataFrame:
    """One primary contact and one use of an address per organization; a warning on the first contact where none is primary.

    The first contacts of each organization and of each address used twice are aggregates, so an organization with very
    many contacts is one row in each.
    """
    org, mail = F.col("payload.organization_id"), F.lower("payload.email")
    primary = F.coalesce(F.col("payload.is_primary") == "true", F.lit(False))
    alive = live() & org.isNotNull()
    first = contacts.where(alive).groupBy(org.alias("_org")).agg(F.min(_place()).alias("_first"), F.min(F.when(primary, _place())).alias("_first_primary"))
    used = contacts.where(alive & mail.isNotNull() & (mail != "")).groupBy(org.alias("_org"), mail.alias("_mail")).agg(F.min(_place()).alias("_first_use"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    c = _matched(_matched(contacts, alive, first, {"_org": org}), alive & mail.isNotNull() & (mail != ""), used, {"_org": org, "_mail": mail})
    second = F.coalesce(primary & (_place() > F.col("_first_primary")), F.lit(False))
    none = F.coalesce((_place() == F.col("_first")) & F.col("_first_primary").isNull(), F.lit(False))
    again = F.coalesce(_place() > F.col("_first_use"), F.lit(False))
    c = with_issue(c, second, issue("duplicate_primary_contact", "error", "is_primary", None, "the organization has a primary contact already", "one primary contact per organization"))
    c = with_issue(c, none, issue("no_primary_contact", "warning", "is_primary", None, "no contact of the organization is primary"))
    c = with_issue(c, again, issue("duplicate_contact_email", "error", "email", mail, "the address is another contact's of the organization"))
    return c.select(contacts.columns)


def check_lifecycle(subscriptions: DataFrame, state: DataFrame) -> DataFrame:
    """No live subscription under a dormant account, refused accounts included."""
    own = state.select("org", F.col("status").alias("_status"), "by_rule")
    asked = live() & F.col("payload.organization_id").isNotNull()
    out = _matched(subscriptions, asked, own, {"org": F.col("payload.organization_id")})
    clash = asked & F.col("_status").isin("inactive", "churned") & F.col("payload.status").isin("trial", "active")
    because = F.when(F.col("by_rule"), "by the dormancy rule").otherwise("by its own status")
    message = F.concat(F.lit("the organization is "), F.col("_status"), F.lit(" "), because)
    return with_issue(out, F.coalesce(clash, F.lit(False)), issue("business_rule_violation", "error", "status", F.col("payload.status"), message)).select(subscriptions.columns)


WATCHED = {"organization": "customer_since", "subscription": "start_date", "activity": "occurred_at"}


def check_future_dates(drafts: DataFrame, entity: str, as_of: str) -> DataFrame:
    if entity not in WATCHED:
        return drafts
    day = F.substring(F.col(f"payload.{WATCHED[entity]}"), 1, 10)
    late = live() & (day.try_cast("date") > F.lit(as_of).cast("date"))
    return with_issue(drafts, F.coalesce(late, F.lit(False)), issue("date_in_future", "warning", WATCHED[entity], day, F.concat(F.lit(f"{WATCHED[entity]} is after {as_of}: "), day)))


def check_tier(subscriptions: DataFrame, organizations: DataFrame, column: str = "customer_tier", tier: str = "strategic", plan: str = "enterprise") -> DataFrame:
    """Accounts of a tier should have a plan; others are flagged, not changed."""
    named = organizations.where(~F.col("skipped") & F.col("record_id").isNotNull() & (F.lower(F.trim(F.col(f"raw.{column}"))) == tier)).select(F.col("record_id").alias("org")).distinct().withColumn("_tier", F.lit(True))
    asked = live() & F.col("payload.organization_id").isNotNull()
    out = _matched(subscriptions, asked, named, {"org": F.col("payload.organization_id")})
    clash = asked & F.col("_tier").isNotNull() & ~F.col("payload.plan").eqNullSafe(F.lit(plan))
    return with_issue(out, clash, issue("plan_conflicts_with_tier", "warning", "plan", F.col("payload.plan"), f"{tier} accounts should have {plan}")).select(subscriptions.columns)


def validate(drafts: dict[str, DataFrame], as_of: dict[str, str] | str) -> dict[str, DataFrame]:
    """All checks in order. as_of may differ by entity. Stages that no result reads are dropped."""
    if not drafts:
        return {}
    stages = Stages(next(iter(drafts.values())).sparkSession, "validate")
    days = {e: as_of if isinstance(as_of, str) else as_of.get(e) for e in ENTITIES}
    out = {e: check_unique_ids(stages.write(check_contract(d, e), f"contract-{e}"), e) for e, d in drafts.items()}
    if "organization" in out:
        out["organization"] = stages.write(out["organization"], "unique-organization")
        state = stages.write(organization_state(out["organization"]), "organization-state")
        out = {e: d if e == "organization" else stages.write(check_parents(d, state), f"parents-{e}") for e, d in out.items()}
        stages.drop(*[f"contract-{e}" for e in out])
        if "contact" in out:
            out["contact"] = check_contacts(out["contact"])
        if "subscription" in out:
            out["subscription"] = check_lifecycle(out["subscription"], state)
    out = {e: check_future_dates(d, e, days[e]) if days[e] else d for e, d in out.items()}
    if "organization" in out and "subscription" in out:
        out["subscription"] = check_tier(out["subscription"], out["organization"])
    return out


def issues_of(drafts: DataFrame) -> DataFrame:
    return drafts.select("entity", "dataset", "source_row", "record_id", F.explode("issues").alias("i")).select("entity", "dataset", "source_row", "record_id", "i.*")


def counts(drafts: DataFrame) -> DataFrame:
    """Per entity: built, skipped, valid, invalid, valid with warnings."""
    n = lambda c: F.count_if(c)
    warned = F.exists("issues", lambda x: x["severity"] == "warning")
    return drafts.groupBy("entity").agg(F.count("*").alias("built"), n(F.col("skipped")).alias("skipped"), n(live()).alias("valid"), n(~F.col("skipped") & has_errors()).alias("invalid"), n(live() & warned).alias("with_warnings"))
