"""Queries over record drafts: projection, record rules and validation, and the SQL that states the same."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.catalogue import converting as c
from quayside.catalogue.profiling import quoted, sql_re, sql_strip
from quayside.catalogue.views import VIEWS, view
from quayside.functions.converters import IDENTIFIER
from quayside.operators import readiness, rules, validate
from quayside.plans.contract import entity_fields
from quayside.plans.drafts import DATASET_BITS, build_plan, compile_drafts, emissions
from quayside.plans.shared import barrier
from quayside.plans.example_config import EXAMPLE

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Day of the checks by entity; events are of another year than orders.
AS_OF = {"organization": EXAMPLE.as_of, "subscription": EXAMPLE.as_of, "activity": "2024-01-15"}

# (view, entity, [(source column, target)], raw columns kept)
DATASETS = {
    "organization": ("messy_organizations", [("acct_num", "organization.organization_id"), ("company_name", "organization.name"), ("company_status", "organization.lifecycle_status"), ("industry_code", "organization.industry"), ("hq_state", "organization.billing_region"), ("country", "organization.billing_country"), ("website", "organization.website"), ("annual_revenue", "organization.annual_revenue_usd"), ("employee_count", "organization.employee_count"), ("created_on", "organization.customer_since"), ("primary_contact_email", "contact.email")], ("country", "customer_tier", "last_activity_date")),
    "contact": ("messy_contacts", [("contact_ref", "contact.contact_id"), ("acct_num", "contact.organization_id"), ("full_name", "contact.first_name"), ("contact_mail", "contact.email"), ("phone_number", "contact.phone"), ("contact_role", "contact.role"), ("is_primary", "contact.is_primary")], ()),
    "subscription": ("messy_subscriptions", [("sub_id", "subscription.subscription_id"), ("acct_num", "subscription.organization_id"), ("subscription_level", "subscription.plan"), ("billing_freq", "subscription.billing_cycle"), ("sub_status", "subscription.status"), ("seat_count", "subscription.seats"), ("start_dt", "subscription.start_date"), ("renew_dt", "subscription.renewal_date"), ("monthly_amount", "subscription.mrr_usd")], ("subscription_level",)),
    "activity": ("messy_activity", [("activity_id", "activity.activity_id"), ("acct_num", "activity.organization_id"), ("activity_type", "activity.kind"), ("occurred_at", "activity.occurred_at"), ("amount", "activity.amount_usd"), ("description", "activity.description")], ()),
}


def plan_of(entity: str):
    source, pairs, raw = DATASETS[entity]
    return build_plan(source, [(s, t, "approved") for s, t in pairs], raw)


def drafts(spark: SparkSession, d: str, entity: str) -> DataFrame:
    return compile_drafts(view(spark, d, DATASETS[entity][0]), plan_of(entity), entity, EXAMPLE)


def ruled(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Drafts of all entities after record rules and the cross-dataset rule."""
    return _after_rules({e: drafts(spark, d, e) for e in DATASETS})


def _after_rules(made: dict[str, DataFrame]) -> dict[str, DataFrame]:
    out = {e: barrier(df, f"drafts-{e}") for e, df in made.items()}
    out["organization"] = barrier(rules.dormant_account_inactive(rules.ca_country_from_region(out["organization"], EXAMPLE), EXAMPLE), "ruled-organization")
    out["subscription"] = barrier(rules.drop_dead_trials(rules.legacy_gold_seat_split(out["subscription"], EXAMPLE), EXAMPLE), "ruled-subscription")
    out["contact"], out["organization"] = rules.primary_from_account_email(out["contact"], out["organization"])
    return {e: barrier(df, f"primary-{e}") if e in ("contact", "organization") else df for e, df in out.items()}


def validated(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return validate.validate(ruled(spark, d), AS_OF)


# --- SQL ---------------------------------------------------------------------------------------

_BODY = {
    "identifier": c.out(f"CASE WHEN {sql_re('s', IDENTIFIER)} THEN s END", c.NONE, f"CASE WHEN NOT {sql_re('s', IDENTIFIER)} THEN 'invalid_identifier' END"),
    "string": c.out("s"), "money": c._MONEY_OUT, "integer": None, "date": None, "datetime": None, "email": None, "phone_e164": None, "url": None, "person_name_split": None, "boolean": None,
}
for _name, _key in (("c07_integer", "integer"), ("c09_date", "date"), ("c10_datetime", "datetime"), ("c11_email", "email"), ("c12_phone_e164", "phone_e164"), ("c13_url", "url"), ("c14_person_name_split", "person_name_split"), ("c08_boolean", "boolean")):
    _BODY[_key] = c.SQL[_name].rsplit("SELECT row_idx, ", 1)[1].removesuffix(" FROM x")


def _body(target: str) -> str:
    last = EXAMPLE.chain(target)[-1]
    if last == "enum_map":
        return c._enum_out(target)
    if last in ("country_code", "region_code"):
        return c._code_out(target, last == "region_code")
    return _BODY[last]


def draft_sql(entity: str) -> str:
    """WITH list: the view, a table for each field, and d_<entity>: payload columns, n_errors, first_error."""
    source, pairs, raw = DATASETS[entity]
    gone = quoted(EXAMPLE.placeholders)
    parts = [f"{source} AS ({VIEWS[source].strip()})"]
    names, joins, errors = [], [], []
    for i, (column, target) in enumerate(pairs):
        clean = sql_strip(rf"regexp_replace({column}, '\s+', ' ', 'g')")
        parts.append(f"f_{entity}_{i} AS (SELECT row_idx, value, error_type FROM (SELECT row_idx, {_body(target)} FROM (SELECT CAST(row_idx AS BIGINT) AS row_idx, t AS raw, t AS s FROM (SELECT row_idx, CASE WHEN {clean} <> '' AND lower({clean}) NOT IN ({gone}) THEN {clean} END AS t FROM {source}))))")
        joins.append(f"JOIN f_{entity}_{i} AS f{i} ON f{i}.row_idx = v.row_idx")
        own = target.startswith(f"{entity}.")
        name = target.split(".")[1] if own else target.replace(".", "_")
        if target == "contact.first_name":
            names += [f"split_part(f{i}.value, chr(9), 1) AS first_name", f"split_part(f{i}.value, chr(9), 2) AS last_name"]
            names = [n.replace("split_part(", "nullif(split_part(").replace(") AS", "), '') AS") if n.startswith("split_part") else n for n in names]
        else:
            names.append(f"f{i}.value AS {name}")
        if own:
            errors.append(f"f{i}.error_type")
    listed = f"list_filter([{', '.join(errors)}, CASE WHEN f0.value IS NULL THEN 'missing_identifier' END], lambda e: e IS NOT NULL)"
    kept = "".join(f", v.{r} AS raw_{r}" for r in raw)
    parts.append(f"d_{entity} AS (SELECT CAST(v.row_idx AS BIGINT) AS source_row, {', '.join(names)}, {listed} AS errs{kept} FROM {source} AS v {' '.join(joins)})")
    return ",\n".join(parts)


def _flat(df: DataFrame, entity: str, fields: list[str]) -> DataFrame:
    errors = F.transform(F.filter("issues", lambda x: x["severity"] == "error"), lambda x: x["error_type"])
    return df.select("source_row", "record_id", *[F.col(f"payload.{f}").alias(f) for f in fields], F.size(errors).cast("long").alias("n_errors"), F.get(errors, 0).alias("first_error"))


for _e, _fields in (("organization", ["name", "lifecycle_status", "industry", "billing_region", "billing_country", "website", "annual_revenue_usd", "employee_count", "customer_since"]), ("contact", ["organization_id", "first_name", "last_name", "email", "phone", "role", "is_primary"]), ("subscription", ["organization_id", "plan", "billing_cycle", "status", "seats", "start_date", "renewal_date", "mrr_usd"]), ("activity", ["organization_id", "kind", "occurred_at", "amount_usd", "description"])):
    Q[f"d01_drafts_{_e}"] = lambda spark, d, e=_e, f=_fields: _flat(drafts(spark, d, e), e, f)
    SQL[f"d01_drafts_{_e}"] = f"WITH {draft_sql(_e)} SELECT source_row, {_e}_id AS record_id, {', '.join(_fields)}, CAST(len(errs) AS BIGINT) AS n_errors, errs[1] AS first_error FROM d_{_e}"

Q["d02_context_fields"] = lambda spark, d: drafts(spark, d, "organization").select("source_row", F.col("context.contact_email").alias("contact_email"), F.col("raw.customer_tier").alias("customer_tier"))
SQL["d02_context_fields"] = f"WITH {draft_sql('organization')} SELECT source_row, contact_email, raw_customer_tier AS customer_tier FROM d_organization"


_APPROVED = """SELECT p_brand || CAST(p_size AS STRING) AS dataset, CASE p_partkey % 6 WHEN 0 THEN 'organization.organization_id' WHEN 1 THEN 'contact.contact_id' WHEN 2 THEN 'contact.organization_id' WHEN 3 THEN 'subscription.subscription_id' WHEN 4 THEN 'activity.activity_id' END AS target,
CASE WHEN p_partkey % 4 = 0 THEN 'rejected' ELSE 'approved' END AS status FROM part"""
Q["d03_entity_emission"] = lambda spark, d: emissions(spark.sql(_APPROVED.replace("FROM part", "FROM {part}"), part=view(spark, d, "part")))
SQL["d03_entity_emission"] = f"SELECT DISTINCT dataset, split_part(target, '.', 1) AS entity FROM ({_APPROVED}) WHERE status = 'approved' AND target <> 'contact.organization_id'"

# Rules over d_organization and d_subscription.
_CA = f"lower({sql_strip("raw_country")}) = 'ca'"
_SEEN = f"try_cast((SELECT {c.DATE} FROM (SELECT nullif({sql_strip("raw_last_activity_date")}, '') AS s)) AS DATE)"
_STALE = f"({_SEEN} < DATE '1999-12-01' AND lifecycle_status IN ('active', 'prospect'))"
RULED = f"""{draft_sql("organization")}, {draft_sql("contact")}, {draft_sql("subscription")}, {draft_sql("activity")},
ro AS (SELECT * REPLACE (CASE WHEN {_CA} AND billing_region IS NOT NULL AND billing_region NOT IN ({quoted(rules.PROVINCES)}) THEN 'US' ELSE billing_country END AS billing_country,
  CASE WHEN {_STALE} THEN 'inactive' ELSE lifecycle_status END AS lifecycle_status), {_STALE} AS by_rule, coalesce({_CA} AND billing_region IS NULL, false) AS doubtful FROM d_organization),
rs0 AS (SELECT *, coalesce(lower({sql_strip("raw_subscription_level")}) = 'legacy gold', false) AS gold FROM d_subscription),
rs AS (SELECT * REPLACE (CASE WHEN gold AND CAST(seats AS BIGINT) < 10 THEN 'professional' ELSE plan END AS plan, CASE WHEN gold AND seats IS NULL THEN list_append(errs, 'undecidable_plan') ELSE errs END AS errs),
  coalesce(status = 'trial' AND date_diff('day', try_cast(start_date AS DATE), DATE '{EXAMPLE.as_of}') > 90, false) AS skipped FROM rs0),
asked AS (SELECT organization_id AS org, source_row AS org_row, lower(contact_email) AS email FROM ro WHERE organization_id IS NOT NULL AND contact_email IS NOT NULL),
per_org AS (SELECT organization_id AS org, bool_or(coalesce(is_primary = 'true', false)) AS has_primary FROM d_contact WHERE organization_id IS NOT NULL GROUP BY organization_id),
chosen AS (SELECT a.org, a.org_row, min(k.source_row) AS pick FROM asked AS a JOIN per_org USING (org) JOIN d_contact AS k ON k.organization_id = a.org AND lower(k.email) = a.email WHERE NOT has_primary GROUP BY a.org, a.org_row),
rc AS (SELECT * REPLACE (CASE WHEN source_row IN (SELECT pick FROM chosen) THEN 'true' ELSE is_primary END AS is_primary) FROM d_contact),
verdict AS (SELECT a.org_row AS source_row, CASE WHEN p.org IS NULL THEN 'primary_contact_missing' WHEN NOT has_primary AND ch.org IS NULL THEN 'primary_contact_not_found' END AS kind
  FROM asked AS a LEFT JOIN per_org AS p USING (org) LEFT JOIN chosen AS ch ON ch.org = a.org AND ch.org_row = a.org_row)"""


def _rule_query(fn, entity, *fields):
    def query(spark: SparkSession, d: str) -> DataFrame:
        out = fn(drafts(spark, d, entity), EXAMPLE)
        return out.select("source_row", *[F.col(f"payload.{f}").alias(f) for f in fields], F.array_join("applied_rules", ",").alias("applied"), F.array_join(F.transform("issues", lambda x: x["error_type"]), ",").alias("issue_types"), "skipped")

    return query


Q["r01_country_from_region"] = lambda spark, d: _rule_query(rules.ca_country_from_region, "organization", "billing_country")(spark, d).select("source_row", "billing_country", "applied")
SQL["r01_country_from_region"] = f"WITH {RULED} SELECT source_row, billing_country, CASE WHEN {_CA} AND billing_region IS NOT NULL THEN 'ca_country_from_region' ELSE '' END AS applied FROM ro"
Q["r02_dormancy"] = lambda spark, d: _rule_query(rules.dormant_account_inactive, "organization", "lifecycle_status")(spark, d).select("source_row", "lifecycle_status", "applied")
SQL["r02_dormancy"] = f"WITH {RULED} SELECT source_row, lifecycle_status, CASE WHEN by_rule THEN 'dormant_account_inactive' ELSE '' END AS applied FROM ro"
Q["r03_alias_threshold"] = lambda spark, d: _rule_query(rules.legacy_gold_seat_split, "subscription", "plan")(spark, d).select("source_row", "plan", "issue_types")
SQL["r03_alias_threshold"] = f"WITH {RULED} SELECT source_row, plan, array_to_string(errs, ',') AS issue_types FROM rs"
Q["r04_skip_old_trials"] = lambda spark, d: _rule_query(rules.drop_dead_trials, "subscription")(spark, d).select("source_row", "skipped")
SQL["r04_skip_old_trials"] = f"WITH {RULED} SELECT source_row, skipped FROM rs"


def _primary(spark: SparkSession, d: str) -> DataFrame:
    out = ruled(spark, d)
    picked = out["contact"].where(F.array_contains("applied_rules", "primary_from_account_email")).select(F.lit("contact").alias("entity"), "source_row", F.lit("primary_from_account_email").alias("what"))
    warned = validate.issues_of(out["organization"]).where("error_type like 'primary_contact%'").select("entity", "source_row", F.col("error_type").alias("what"))
    return picked.unionByName(warned)


Q["r05_primary_from_email"] = _primary
SQL["r05_primary_from_email"] = f"WITH {RULED} SELECT 'contact' AS entity, pick AS source_row, 'primary_from_account_email' AS what FROM (SELECT DISTINCT pick FROM chosen) UNION ALL SELECT 'organization', source_row, kind FROM verdict WHERE kind IS NOT NULL"

# Validation, check by check. e: an error; flags of each check stay in columns.


def _missing(entity: str) -> str:
    own = {s.split(".")[1] for _, s in DATASETS[entity][1]} | ({"last_name"} if entity == "contact" else set())
    need = [f for f, spec in entity_fields(entity).items() if spec.required]
    return "[" + ", ".join(f"CASE WHEN {f} IS NULL THEN 'missing_required' END" if f in own else "'missing_required'" for f in need) + "]"


def _contract(entity: str, source: str, more: str = "[]", skipped: str = "false") -> str:
    return f"v_{entity} AS (SELECT * REPLACE (CASE WHEN {skipped} THEN errs ELSE errs || list_filter({_missing(entity)} || {more}, lambda e: e IS NOT NULL) END AS errs) FROM {source})"


_SUB_MORE = "[CASE WHEN CAST(seats AS BIGINT) < 1 THEN 'out_of_range' END, CASE WHEN CAST(renewal_date AS DATE) <= CAST(start_date AS DATE) THEN 'invalid_value' END]"


def _unique(entity: str) -> str:
    alive = "len(errs) = 0" + (" AND NOT skipped" if entity == "subscription" else "") + f" AND {entity}_id IS NOT NULL"
    return f"u_{entity} AS (SELECT *, {alive} AND row_number() OVER (PARTITION BY {entity}_id, {alive} ORDER BY source_row) > 1 AS dup FROM v_{entity}), n_{entity} AS (SELECT * REPLACE (CASE WHEN dup THEN list_append(errs, 'duplicate_identifier') ELSE errs END AS errs) FROM u_{entity})"


def _parents(entity: str) -> str:
    alive = "len(errs) = 0" + (" AND NOT skipped" if entity == "subscription" else "")
    return f"""p_{entity} AS (SELECT *, CASE WHEN {alive} AND organization_id IS NOT NULL AND NOT coalesce(o.migrating, false) THEN CASE WHEN o.org IS NULL THEN 'missing_relationship' ELSE 'parent_record_rejected' END END AS lost FROM n_{entity} LEFT JOIN state AS o ON o.org = organization_id),
q_{entity} AS (SELECT * REPLACE (CASE WHEN lost IS NOT NULL THEN list_append(errs, lost) ELSE errs END AS errs) FROM p_{entity})"""


VALIDATED = f"""{RULED},
{_contract("organization", "ro")}, {_contract("contact", "rc")}, {_contract("subscription", "rs", _SUB_MORE, "skipped")}, {_contract("activity", "d_activity")},
{_unique("organization")}, {_unique("contact")}, {_unique("subscription")}, {_unique("activity")},
state AS (SELECT organization_id AS org, bool_or(len(errs) = 0) AS migrating, arg_max(lifecycle_status, source_row) AS org_status FROM n_organization WHERE organization_id IS NOT NULL GROUP BY organization_id),
{_parents("contact")}, {_parents("subscription")}, {_parents("activity")},
w_contact AS (SELECT *, len(errs) = 0 AS alive, coalesce(is_primary = 'true', false) AS prim FROM q_contact),
x_contact AS (SELECT *, alive AND prim AND row_number() OVER (PARTITION BY organization_id, alive, prim ORDER BY source_row) > 1 AS two,
  alive AND NOT bool_or(prim) OVER (PARTITION BY organization_id, alive) AND row_number() OVER (PARTITION BY organization_id, alive ORDER BY source_row) = 1 AS none,
  alive AND email IS NOT NULL AND row_number() OVER (PARTITION BY organization_id, alive, lower(email) ORDER BY source_row) > 1 AS again FROM w_contact),
y_contact AS (SELECT * REPLACE (errs || list_filter([CASE WHEN two THEN 'duplicate_primary_contact' END, CASE WHEN again THEN 'duplicate_contact_email' END], lambda e: e IS NOT NULL) AS errs) FROM x_contact),
x_subscription AS (SELECT *, coalesce(len(errs) = 0 AND NOT skipped AND org_status IN ('inactive', 'churned') AND status IN ('trial', 'active'), false) AS clash FROM q_subscription),
y_subscription AS (SELECT * REPLACE (CASE WHEN clash THEN list_append(errs, 'business_rule_violation') ELSE errs END AS errs) FROM x_subscription),
tier AS (SELECT DISTINCT organization_id AS org FROM n_organization WHERE organization_id IS NOT NULL AND lower(trim(raw_customer_tier)) = 'strategic')"""


def _by_type(entity: str, *types: str):
    return lambda spark, d: validate.issues_of(validated(spark, d)[entity]).where(F.col("error_type").isin(*types)).select("entity", "source_row", "error_type")


def _all_types(entities: tuple[str, ...], *types: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        found, out = validated(spark, d), None
        for e in entities:
            own = validate.issues_of(found[e]).where(F.col("error_type").isin(*types)).select("entity", "source_row", "error_type")
            out = own if out is None else out.unionByName(own)
        return out

    return query


_ALL = ("organization", "contact", "subscription", "activity")


def _contract_counts(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for e, df in ruled(spark, d).items():
        own = validate.issues_of(validate.check_contract(df, e)).where("severity = 'error'").groupBy("entity", "error_type").agg(F.count("*").alias("n"))
        out = own if out is None else out.unionByName(own)
    return out


Q["v01_contract"] = _contract_counts
SQL["v01_contract"] = f"WITH {VALIDATED} SELECT entity, error_type, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{e}' AS entity, unnest(errs) AS error_type FROM v_{e}" for e in _ALL) + ") GROUP BY ALL"
Q["v02_unique_ids"] = _all_types(_ALL, "duplicate_identifier")
SQL["v02_unique_ids"] = f"WITH {VALIDATED} " + " UNION ALL ".join(f"SELECT '{e}' AS entity, source_row, 'duplicate_identifier' AS error_type FROM u_{e} WHERE dup" for e in _ALL)
Q["v03_parents"] = _all_types(_ALL[1:], "parent_record_rejected", "missing_relationship")
SQL["v03_parents"] = f"WITH {VALIDATED} " + " UNION ALL ".join(f"SELECT '{e}' AS entity, source_row, lost AS error_type FROM p_{e} WHERE lost IS NOT NULL" for e in _ALL[1:])
Q["v04_one_primary"] = _by_type("contact", "duplicate_primary_contact", "no_primary_contact")
SQL["v04_one_primary"] = f"WITH {VALIDATED} SELECT 'contact' AS entity, source_row, 'duplicate_primary_contact' AS error_type FROM x_contact WHERE two UNION ALL SELECT 'contact', source_row, 'no_primary_contact' FROM x_contact WHERE none"
Q["v05_unique_email"] = _by_type("contact", "duplicate_contact_email")
SQL["v05_unique_email"] = f"WITH {VALIDATED} SELECT 'contact' AS entity, source_row, 'duplicate_contact_email' AS error_type FROM x_contact WHERE again"
Q["v06_lifecycle"] = _by_type("subscription", "business_rule_violation")
SQL["v06_lifecycle"] = f"WITH {VALIDATED} SELECT 'subscription' AS entity, source_row, 'business_rule_violation' AS error_type FROM x_subscription WHERE clash"
Q["v07_future_dates"] = _all_types(_ALL, "date_in_future")
SQL["v07_future_dates"] = f"""WITH {VALIDATED} SELECT 'organization' AS entity, source_row, 'date_in_future' AS error_type FROM n_organization WHERE len(errs) = 0 AND try_cast(customer_since AS DATE) > DATE '{AS_OF["organization"]}'
UNION ALL SELECT 'subscription', source_row, 'date_in_future' FROM y_subscription WHERE len(errs) = 0 AND NOT skipped AND try_cast(start_date AS DATE) > DATE '{AS_OF["subscription"]}'
UNION ALL SELECT 'activity', source_row, 'date_in_future' FROM q_activity WHERE len(errs) = 0 AND try_cast(substr(occurred_at, 1, 10) AS DATE) > DATE '{AS_OF["activity"]}'"""
Q["v08_tier"] = _by_type("subscription", "plan_conflicts_with_tier")
SQL["v08_tier"] = f"WITH {VALIDATED} SELECT 'subscription' AS entity, source_row, 'plan_conflicts_with_tier' AS error_type FROM y_subscription WHERE len(errs) = 0 AND NOT skipped AND organization_id IN (SELECT org FROM tier) AND plan IS DISTINCT FROM 'enterprise'"


def _counts(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for df in validated(spark, d).values():
        own = validate.counts(df).select("entity", "built", "skipped", "valid", "invalid")
        out = own if out is None else out.unionByName(own)
    return out


Q["v09_counts"] = _counts
SQL["v09_counts"] = f"WITH {VALIDATED} " + " UNION ALL ".join(
    f"SELECT '{e}' AS entity, count(*) AS built, count(*) FILTER (WHERE {s}) AS skipped, count(*) FILTER (WHERE len(errs) = 0 AND NOT {s}) AS valid, count(*) FILTER (WHERE len(errs) > 0 AND NOT {s}) AS invalid FROM {t}"
    for e, t, s in (("organization", "n_organization", "false"), ("contact", "y_contact", "false"), ("subscription", "y_subscription", "skipped"), ("activity", "q_activity", "false"))
)


# The same over two exports per entity, whose names sort against the order of their plans and whose row numbers overlap.
_EXPORTS = ("west", "east")


def two_exports(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Drafts of all entities, each from two exports, after the rules."""
    made: dict[str, DataFrame] = {}
    for e, (source, _, _) in DATASETS.items():
        for rank, name in enumerate(_EXPORTS):
            rows = view(spark, d, source).where(F.col("row_idx") % 2 != rank).withColumn("row_idx", F.floor(F.col("row_idx") / 2))
            own = compile_drafts(rows, dataclasses.replace(plan_of(e), dataset=name), e, EXAMPLE, rank=rank)
            made[e] = own if rank == 0 else made[e].unionByName(own)
    return _after_rules(made)


def _two_exports(spark: SparkSession, d: str) -> DataFrame:
    after = two_exports(spark, d)
    picked = after["contact"].where(F.array_contains("applied_rules", "primary_from_account_email"))
    out = picked.select("entity", "dataset", "source_row", F.lit("primary_from_account_email").alias("what"))
    for df in validate.validate(after, AS_OF).values():
        out = out.unionByName(validate.issues_of(df).where("severity = 'error' or error_type like '%primary_contact%'").select("entity", "dataset", "source_row", F.col("error_type").alias("what")))
    return out


Q["v10_two_exports"] = _two_exports
_TWICE = VALIDATED
for _source, _, _ in DATASETS.values():
    _own = VIEWS[_source].strip()
    _TWICE = _TWICE.replace(f"({_own})", f"(SELECT * REPLACE (CASE WHEN row_idx % 2 = 1 THEN 0 ELSE {1 << DATASET_BITS} END + row_idx // 2 AS row_idx) FROM ({_own}))")
_FOUND = " UNION ALL ".join(f"SELECT '{e}' AS entity, source_row, unnest(errs) AS what FROM {t}" for e, t in (("organization", "n_organization"), ("contact", "y_contact"), ("subscription", "y_subscription"), ("activity", "q_activity")))
SQL["v10_two_exports"] = f"""WITH {_TWICE}
SELECT entity, CASE WHEN source_row >= {1 << DATASET_BITS} THEN 'east' ELSE 'west' END AS dataset, source_row % {1 << DATASET_BITS} AS source_row, what FROM ({_FOUND}
UNION ALL SELECT 'contact', source_row, 'no_primary_contact' FROM x_contact WHERE none
UNION ALL SELECT 'organization', source_row, kind FROM verdict WHERE kind IS NOT NULL
UNION ALL SELECT 'contact', pick, 'primary_from_account_email' FROM (SELECT DISTINCT pick FROM chosen))"""


def _rule_counts(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for df in ruled(spark, d).values():
        own = df.select("applied_rules", "skipped", "skip_rule")
        out = own if out is None else out.unionByName(own)
    return readiness.rule_counts(out)


_APPLIED = {
    "ca_country_from_region": f"SELECT count(*) AS n FROM ro WHERE {_CA} AND billing_region IS NOT NULL",
    "dormant_account_inactive": "SELECT count(*) FROM ro WHERE by_rule",
    "legacy_gold_seat_split": "SELECT count(*) FROM rs WHERE gold AND CAST(seats AS BIGINT) < 10",
    "primary_from_account_email": "SELECT count(DISTINCT pick) FROM chosen",
    "drop_dead_trials: records not migrated": "SELECT count(*) FROM rs WHERE skipped",
}
Q["r06_rule_counts"] = _rule_counts
SQL["r06_rule_counts"] = f"WITH {RULED} SELECT rule, n FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS rule, ({v}) AS n" for k, v in _APPLIED.items()) + ") WHERE n > 0"
