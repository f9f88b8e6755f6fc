"""Queries over writes, reconciliation, mappings and readiness, on inputs staged from the driver's tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.catalogue import records as rec
from quayside.catalogue.converting import SQL as CONVERTED
from quayside.catalogue.views import view
from quayside.operators import compare, evaluation, readiness, reconcile, review, write
from quayside.plans.contract import CONTRACT, catalog
from quayside.plans.shared import shared_folder
from quayside.plans.stores import Store
from quayside.sources import files
from quayside.sources.synthetic import organizations

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _from(table: str, sql: str):
    """Rows of a driver table, by SQL that runs in both engines."""

    def rows(spark: SparkSession, d: str) -> DataFrame:
        return spark.sql(sql.replace(f"FROM {table}", f"FROM {{{table}}}"), **{table: view(spark, d, table)})

    return rows


_RECORDS = "SELECT CAST(o_custkey AS STRING) AS id, o_orderstatus AS content_hash, o_orderkey AS ord FROM orders"
_HELD = "SELECT CAST(c_custkey AS STRING) AS id, 'O' AS content_hash FROM customer WHERE c_custkey % 3 = 0"


def _hashed(df: DataFrame) -> DataFrame:
    """The column that tells records apart becomes a payload, and its hash the content."""
    return df.withColumn("payload", F.struct(F.col("content_hash").alias("status"))).withColumn("content_hash", write.content_hash()).drop("payload")


Q["w01_classify_writes"] = lambda s, d: write.classify_writes(_hashed(_from("orders", _RECORDS)(s, d)), _hashed(_from("customer", _HELD)(s, d))).select("id", "ord", "outcome")
SQL["w01_classify_writes"] = f"""WITH r AS ({_RECORDS}), h AS ({_HELD}),
j AS (SELECT r.*, h.content_hash AS held, row_number() OVER (PARTITION BY r.id ORDER BY ord) AS n, first_value(r.content_hash) OVER (PARTITION BY r.id ORDER BY ord) AS f FROM r LEFT JOIN h ON h.id = r.id)
SELECT id, ord, CASE WHEN held IS NULL AND n = 1 THEN 'created' WHEN content_hash = coalesce(held, f) THEN 'unchanged' ELSE 'conflict' END AS outcome FROM j"""
_ACCEPTED = "SELECT c_custkey AS id FROM customer WHERE c_custkey % 5 <> 0"
_CHILDREN = "SELECT o_orderkey AS child_id, o_custkey AS organization_id FROM orders"
Q["w02_blocked_children"] = lambda s, d: write.blocked_children(_from("orders", _CHILDREN)(s, d), _from("customer", _ACCEPTED)(s, d)).select("child_id", "organization_id")
SQL["w02_blocked_children"] = f"SELECT child_id, organization_id FROM ({_CHILDREN}) WHERE organization_id NOT IN ({_ACCEPTED})"
_ATTEMPTS = "SELECT o_orderpriority AS entity, o_orderkey AS ord, CAST(o_orderkey % 4 AS INT) AS entity_rank, CASE WHEN o_orderkey % 100 < 12 THEN 'failed' WHEN o_orderkey % 13 = 0 THEN 'rejected' ELSE 'accepted' END AS outcome FROM orders"
Q["w03_stop_after_failures"] = lambda s, d: write.stop_after_failures(_from("orders", _ATTEMPTS)(s, d), 25).select("entity", "ord", "not_attempted")
SQL["w03_stop_after_failures"] = f"SELECT entity, ord, coalesce(sum(CASE WHEN outcome <> 'accepted' THEN 1 ELSE 0 END) OVER (PARTITION BY entity ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= 25 AS not_attempted FROM ({_ATTEMPTS})"
Q["w04_breaker"] = lambda s, d: write.breaker(_from("orders", _ATTEMPTS)(s, d), 3).select("ord", F.col("run").cast("long").alias("run"), "not_attempted")
SQL["w04_breaker"] = f"""WITH a AS (SELECT *, row_number() OVER (ORDER BY entity_rank, ord) AS p FROM ({_ATTEMPTS})),
g AS (SELECT *, p - row_number() OVER (PARTITION BY outcome = 'failed' ORDER BY p) AS isle FROM a),
r AS (SELECT ord, p, CASE WHEN outcome = 'failed' THEN row_number() OVER (PARTITION BY outcome = 'failed', isle ORDER BY p) ELSE 0 END AS run FROM g)
SELECT ord, CAST(run AS BIGINT) AS run, coalesce(p > (SELECT min(p) FROM r WHERE run >= 3), false) AS not_attempted FROM r"""
_SENT = "SELECT 'subscription' AS entity, CAST(o_orderkey AS STRING) AS id FROM orders"
Q["w05_faults"] = lambda s, d: write.draw_faults(_from("orders", _SENT)(s, d), seed=7, rate=0.3)
Q["w06_limit_per_entity"] = lambda s, d: write.limit_per_entity(_from("orders", _ATTEMPTS)(s, d), 100).select("entity", "ord", "not_attempted")
SQL["w06_limit_per_entity"] = f"SELECT entity, ord, row_number() OVER (PARTITION BY entity ORDER BY ord) > 100 AS not_attempted FROM ({_ATTEMPTS})"

_ORGS = """SELECT CAST(c_custkey - CASE WHEN c_custkey % 50 = 0 THEN 1 ELSE 0 END AS STRING) AS id, c_custkey AS ord, CASE WHEN c_custkey % 100 = 0 THEN 'other' ELSE 'same' END AS content_hash,
CASE c_custkey % 4 WHEN 0 THEN 'inactive' WHEN 1 THEN 'churned' ELSE 'active' END AS status, c_custkey % 17 = 0 AS fault FROM customer"""
_CONTACTS = """SELECT CAST(o_orderkey AS STRING) AS id, o_orderkey AS ord, 'same' AS content_hash, CAST(o_custkey AS STRING) AS organization_id, o_orderkey % 5 = 0 AS is_primary,
CASE o_orderkey % 3 WHEN 0 THEN 'A' ELSE 'a' END || CAST(o_orderkey % 7 AS STRING) || '@x.com' AS email, o_orderkey % 41 = 0 AS fault FROM orders WHERE o_orderkey % 2 = 0"""
_SUBS = """SELECT CAST(o_orderkey AS STRING) AS id, o_orderkey AS ord, 'same' AS content_hash, CAST(o_custkey AS STRING) AS organization_id,
CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'F' THEN 'cancelled' ELSE 'trial' END AS status, false AS fault FROM orders WHERE o_orderkey % 2 = 1"""


def _sent(s: SparkSession, d: str) -> dict[str, DataFrame]:
    return {"organization": _from("customer", _ORGS)(s, d), "contact": _from("orders", _CONTACTS)(s, d), "subscription": _from("orders", _SUBS)(s, d)}


#: The target's rules one after the other: organizations, then contacts in their order, then subscriptions.
_WRITTEN = f"""o AS (SELECT *, CASE WHEN NOT fault THEN row_number() OVER (PARTITION BY id, fault ORDER BY ord) END AS n, first_value(content_hash) OVER (PARTITION BY id, fault ORDER BY ord) AS f, min(ord) OVER (PARTITION BY id, fault) AS f_ord FROM ({_ORGS})),
oo AS (SELECT 'organization' AS entity, 0 AS rank, id, ord, CASE WHEN fault THEN 'failed' WHEN n = 1 THEN 'created' WHEN content_hash = f THEN 'unchanged' ELSE 'rejected' END AS outcome, status FROM o),
acc AS (SELECT id, arg_min(status, ord) AS status FROM oo WHERE outcome IN ('created', 'unchanged') GROUP BY id),
c AS (SELECT k.*, lower(email) AS mail, organization_id IN (SELECT id FROM acc) AS held FROM ({_CONTACTS}) AS k),
np AS (SELECT organization_id, mail, min(ord) AS np FROM c WHERE held AND NOT fault AND NOT is_primary GROUP BY ALL),
cn AS (SELECT c.*, np FROM c LEFT JOIN np USING (organization_id, mail)),
ld AS (SELECT organization_id, min(ord) AS lead, arg_min(mail, ord) AS lead_mail FROM cn WHERE held AND NOT fault AND is_primary AND (np IS NULL OR ord < np) GROUP BY organization_id),
cc AS (SELECT id, ord, CASE WHEN NOT held THEN 'parent_not_in_target' WHEN fault THEN 'target_unavailable' WHEN is_primary AND ord > lead THEN 'duplicate_primary_contact' WHEN is_primary AND (lead IS NULL OR ord < lead) THEN 'duplicate_contact_email'
  WHEN NOT is_primary AND (ord <> np OR (lead_mail = mail AND lead < ord)) THEN 'duplicate_contact_email' END AS err FROM cn LEFT JOIN ld USING (organization_id)),
s AS (SELECT k.id, k.ord, CASE WHEN acc.id IS NULL THEN 'parent_not_in_target' WHEN acc.status IN ('inactive', 'churned') AND k.status IN ('trial', 'active') THEN 'business_rule_violation' END AS err FROM ({_SUBS}) AS k LEFT JOIN acc ON acc.id = k.organization_id),
w AS (SELECT entity, rank, id, ord, outcome, CASE outcome WHEN 'failed' THEN 'target_unavailable' WHEN 'rejected' THEN 'duplicate_identifier' END AS error_type FROM oo
UNION ALL SELECT 'contact', 1, id, ord, CASE err WHEN 'parent_not_in_target' THEN 'blocked' WHEN 'target_unavailable' THEN 'failed' ELSE CASE WHEN err IS NULL THEN 'created' ELSE 'rejected' END END, err FROM cc
UNION ALL SELECT 'subscription', 2, id, ord, CASE WHEN err = 'parent_not_in_target' THEN 'blocked' WHEN err IS NULL THEN 'created' ELSE 'rejected' END, err FROM s)"""
Q["w07_dry_run"] = lambda s, d: write.dry_run(_sent(s, d), threshold=1_000_000)
SQL["w07_dry_run"] = f"WITH {_WRITTEN} SELECT entity, id, ord, outcome, error_type FROM w"
#: Refusals of an entity after which it stops.
_STOP = 20
Q["w08_dry_run_stops"] = lambda s, d: write.dry_run({"organization": _from("customer", _ORGS)(s, d)}, limit=1_000, stop_after=_STOP, threshold=10)
SQL["w08_dry_run_stops"] = f"""WITH {_WRITTEN}, q AS (SELECT *, row_number() OVER (ORDER BY ord) AS n FROM w WHERE entity = 'organization'),
r AS (SELECT *, coalesce(sum(CASE WHEN n <= 1000 AND outcome IN ('failed', 'rejected') THEN 1 ELSE 0 END) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bad FROM q)
SELECT entity, id, ord, CASE WHEN n > 1000 OR bad >= {_STOP} THEN 'not_attempted' ELSE outcome END AS outcome, CASE WHEN NOT (n > 1000 OR bad >= {_STOP}) THEN error_type END AS error_type FROM r"""
_STORED = "SELECT CAST(c_custkey AS STRING) AS id, c_mktsegment AS segment, CAST(c_nationkey AS STRING) AS nation, c_name AS name FROM customer"
_RESENT = "SELECT CAST(c_custkey AS STRING) AS id, c_custkey AS ord, CASE WHEN c_custkey % 3 = 0 THEN 'NEW' ELSE c_mktsegment END AS segment, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE CAST(c_nationkey AS STRING) END AS nation, c_name AS name FROM customer"


def _changed(s: SparkSession, d: str) -> DataFrame:
    new, old = _from("customer", _RESENT)(s, d), _from("customer", _STORED)(s, d)
    return write.changed_fields(new.select("id", "ord", F.struct("segment", "nation", "name").alias("payload")), old.select("id", F.struct("segment", "nation", "name").alias("payload")))


Q["w09_changed_fields"] = _changed
SQL["w09_changed_fields"] = f"""SELECT id, ord, concat_ws(',', CASE WHEN n.nation IS DISTINCT FROM o.nation THEN 'nation' END, CASE WHEN n.segment <> o.segment THEN 'segment' END) AS changed
FROM ({_RESENT}) AS n JOIN ({_STORED}) AS o USING (id) WHERE n.nation IS DISTINCT FROM o.nation OR n.segment <> o.segment"""

_RUN = """SELECT o_orderpriority AS entity, CAST(o_orderkey AS STRING) AS id, o_orderkey % 19 = 0 AS skipped, CASE WHEN o_orderkey % 7 = 0 THEN 'missing_required' END AS first_error,
CASE WHEN o_orderkey % 19 = 0 OR o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN 'blocked' WHEN o_orderkey % 13 = 0 THEN 'rejected' WHEN o_orderkey % 17 = 0 THEN 'failed' WHEN o_orderkey % 23 = 0 THEN 'not_attempted' ELSE 'accepted' END AS outcome FROM orders"""
_N = lambda c: f"count(*) FILTER (WHERE {c})"
_LEDGER = f"""SELECT entity, count(*) AS source_rows, count(*) AS built, {_N("skipped")} AS skipped, {_N("NOT skipped AND first_error IS NOT NULL")} AS excluded, {_N("NOT skipped AND first_error IS NOT NULL")} AS explained, {_N("outcome IS NOT NULL")} AS valid,
{_N("outcome IN ('accepted', 'rejected', 'failed')")} AS attempted, {", ".join(f"{_N(f"outcome = '{k}'")} AS {k}" for k in ("blocked", "not_attempted", "accepted", "rejected", "failed"))} FROM ({_RUN}) GROUP BY entity"""
_run = _from("orders", _RUN)
#: What the target holds: accepted ids but for some, and some failed writes that landed.
_LANDED = "(outcome = 'accepted' AND CAST(id AS INT) % 101 <> 0) OR (outcome = 'failed' AND CAST(id AS INT) % 2 = 0)"


def _difference(s: SparkSession, d: str) -> DataFrame:
    r = _run(s, d)
    return reconcile.id_difference(r.where("outcome = 'accepted'"), r.where(_LANDED), r.where("outcome in ('failed', 'rejected')"))


Q["k01_ledger"] = lambda s, d: reconcile.ledger(_run(s, d))
SQL["k01_ledger"] = _LEDGER
Q["k02_checks"] = lambda s, d: reconcile.checks(reconcile.ledger(_run(s, d)), _run(s, d).where(_LANDED), _difference(s, d))
_OFF = f"SELECT entity, {_N(f"outcome = 'accepted' AND NOT ({_LANDED})")} AS missing, {_N(f"outcome <> 'accepted' AND ({_LANDED})")} AS unexpected, {_N(_LANDED)} AS held FROM ({_RUN}) GROUP BY entity"
SQL["k02_checks"] = f"""WITH l AS ({_LEDGER}), o AS ({_OFF}), f AS (SELECT * FROM l JOIN o USING (entity)),
c AS (SELECT entity, 'rows_to_records' AS "check", source_rows AS expected, built AS actual, source_rows = built AS ok FROM f
UNION ALL SELECT entity, 'records_accounted', built, skipped + excluded + valid, built = skipped + excluded + valid FROM f
UNION ALL SELECT entity, 'exclusions_explained', excluded, explained, excluded = explained FROM f
UNION ALL SELECT entity, 'valid_accounted', valid, attempted + blocked + not_attempted, valid = attempted + blocked + not_attempted FROM f
UNION ALL SELECT entity, 'sent_accounted', attempted, accepted + rejected + failed, attempted = accepted + rejected + failed FROM f
UNION ALL SELECT entity, 'target_count', accepted, held, accepted = held FROM f
UNION ALL SELECT entity, 'target_ids', accepted, accepted - missing, missing = 0 AND unexpected = 0 FROM f) SELECT * FROM c"""
Q["k03_id_difference"] = _difference
SQL["k03_id_difference"] = f"""SELECT entity, id, 'missing_in_target' AS kind FROM ({_RUN}) WHERE outcome = 'accepted' AND NOT ({_LANDED})
UNION ALL SELECT entity, id, 'unexpected_in_target' FROM ({_RUN}) WHERE outcome <> 'accepted' AND ({_LANDED})
UNION ALL SELECT entity, id, 'refused_but_present' FROM ({_RUN}) WHERE outcome IN ('failed', 'rejected') AND ({_LANDED})"""
Q["k04_totals"] = lambda s, d: reconcile.totals(reconcile.ledger(_run(s, d)))
SQL["k04_totals"] = f"SELECT {', '.join(f'CAST(sum({k}) AS BIGINT) AS {k}' for k in reconcile.COUNTS)} FROM ({_LEDGER})"
Q["k05_coverage"] = lambda s, d: reconcile.coverage(reconcile.ledger(_run(s, d)))
SQL["k05_coverage"] = f"SELECT entity, built - skipped AS in_scope, accepted, round_even(accepted / CAST(built - skipped AS DOUBLE), 4) AS coverage FROM ({_LEDGER})"

Q["k06_first_errors"] = lambda s, d: reconcile.first_errors(_run(s, d))
SQL["k06_first_errors"] = f"SELECT entity, first_error, count(*) AS n FROM ({_RUN}) WHERE NOT skipped AND first_error IS NOT NULL GROUP BY ALL"
Q["k07_discrepancies"] = lambda s, d: reconcile.discrepancies(Q["k02_checks"](s, d), _difference(s, d))
SQL["k07_discrepancies"] = f"""WITH d AS ({SQL["k03_id_difference"]}), o AS (SELECT *, row_number() OVER (PARTITION BY entity, kind ORDER BY id) AS n FROM d WHERE kind <> 'refused_but_present')
SELECT entity, kind, count(*) AS count, string_agg(id, ',' ORDER BY id) FILTER (WHERE n <= 10) AS sample_ids FROM o GROUP BY entity, kind
UNION ALL SELECT entity, "check", abs(expected - actual), '' FROM ({SQL["k02_checks"]}) WHERE NOT ok AND "check" NOT LIKE 'target_%'"""
Q["k08_status"] = lambda s, d: reconcile.status(Q["k02_checks"](s, d))
SQL["k08_status"] = f"SELECT count(*) AS checks, {_N('ok')} AS passed, CASE WHEN bool_and(ok) THEN 'balanced' ELSE 'discrepancies' END AS status FROM ({SQL['k02_checks']})"
#: A priority that the target would not give back.
_LOST = "1-URGENT"
Q["k09_unreadable"] = lambda s, d: reconcile.checks(reconcile.ledger(_run(s, d)), _run(s, d).where(_LANDED), _difference(s, d), (_LOST,))
SQL["k09_unreadable"] = f"""SELECT * FROM ({SQL["k02_checks"]}) WHERE entity <> '{_LOST}' OR "check" NOT IN ('target_count', 'target_ids')
UNION ALL SELECT entity, 'target_readable', accepted, 0, false FROM ({_LEDGER}) WHERE entity = '{_LOST}'"""
#: Later the target holds what it should but for some.
_LATER = "outcome = 'accepted' AND CAST(id AS INT) % 501 <> 0"


def _later(s: SparkSession, d: str) -> DataFrame:
    r = _run(s, d)
    off = reconcile.id_difference(r.where("outcome = 'accepted'"), r.where(_LATER), r.where("outcome in ('failed', 'rejected')"))
    return reconcile.recheck(Q["k02_checks"](s, d), reconcile.checks(reconcile.ledger(r), r.where(_LATER), off))


Q["k10_recheck"] = _later
SQL["k10_recheck"] = f"""WITH n AS (SELECT entity, {_N("outcome = 'accepted'")} AS accepted, {_N(_LATER)} AS held FROM ({_RUN}) GROUP BY entity),
now AS (SELECT entity, 'target_count' AS "check", held AS actual_now, accepted = held AS ok_now FROM n UNION ALL SELECT entity, 'target_ids', held, accepted = held FROM n)
SELECT entity, "check", actual AS actual_then, actual_now, ok AS ok_then, ok_now FROM ({SQL["k02_checks"]}) JOIN now USING (entity, "check") WHERE actual <> actual_now OR ok <> ok_now"""



def _pick(at: str, words: list[str]) -> str:
    return f"CASE CAST({at} AS INT) " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(words[:-1])) + f" ELSE '{words[-1]}' END"


_FIRST = ["acct", "company", "contact", "billing", "start", "renew", "annual", "customer", "seat", "phone", "role", "subscription", "industry", "email", "foo"]
_SECOND = ["_num", "Name", "_mail", "_country", "_dt", "Status", "_revenue", "s", "_count", "_number", "", "_id", "Date", "_title"]
_NAME = f"{_pick('floor(p_partkey / 6) % 15', _FIRST)} || {_pick('p_size % 14', _SECOND)}"
#: Columns of exports, named by the parts; two of the exports tell of no entity.
_NAMED = f"SELECT p_partkey, p_size, {_pick('p_partkey % 6', ['accounts.csv', 'people.csv', 'subs_export.csv', 'activity_log.csv', 'misc.csv', 'extra.csv'])} AS dataset, {_NAME} AS source_field FROM part"
_FIELDS = f"SELECT DISTINCT dataset, source_field FROM ({_NAMED}) AS named"
_KINDS = ["text", "email", "date", "integer", "datetime", "phone", "empty", "decimal", "url", "boolean", "identifier"]
#: What is known of the values of most of them.
_FACTS = f"""SELECT dataset, source_field, {_pick('min(p_partkey) % 11', _KINDS)} AS inferred_type, CAST(sum(CASE WHEN p_size % 7 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS malformed, CAST(sum(CASE WHEN p_size % 5 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS uppercase,
CAST(count(DISTINCT p_partkey % 2) AS BIGINT) AS date_formats, CAST(CASE WHEN min(p_partkey) % 3 = 0 THEN 50 ELSE 100 END AS DOUBLE) AS iso_pct, CAST(count(*) AS BIGINT) AS non_null, CAST(max(p_size) * 60 AS BIGINT) AS max_length, CAST(min(p_size) % 3 AS BIGINT) AS whitespace
FROM ({_NAMED}) AS named GROUP BY dataset, source_field HAVING min(p_partkey) % 5 > 0"""
_FACT_NAMES = ["inferred_type", "malformed", "uppercase", "date_formats", "iso_pct", "non_null", "max_length", "whitespace"]


def _values(rows: list[tuple], names: str) -> str:
    lit = lambda v: "CAST(NULL AS VARCHAR)" if v is None else f"'{v}'"
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS t({names}))"


_fields = _from("part", _FIELDS)


def _facts(s: SparkSession, d: str) -> DataFrame:
    more = [x.rsplit(" ", 1) if "<" not in x else x.split(" ", 1) for x in compare.FACTS.replace("string, bigint", "string,bigint").split(", ")]
    return _from("part", _FACTS)(s, d).select("*", *[F.lit(None).cast(kind).alias(name) for name, kind in more if name not in _FACT_NAMES])


def _candidates(s: SparkSession, d: str) -> DataFrame:
    return compare.judged(compare.candidates(_fields(s, d), catalog(s)), _facts(s, d), catalog(s))


def _classes(s: SparkSession, d: str) -> DataFrame:
    return compare.classify(_candidates(s, d), _fields(s, d))


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _map(pairs: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in pairs.items()) + "}"


def _words(name: str) -> str:
    split = rf"regexp_extract_all(lower(regexp_replace({name}, '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[a-z0-9]+')"
    one = "CASE WHEN w LIKE '%ies' AND len(w) > 4 THEN left(w, len(w) - 3) || 'y' WHEN w LIKE '%s' AND len(w) > 3 AND NOT regexp_matches(w, '(ss|us|is)$') THEN left(w, len(w) - 1) ELSE w END"
    synonyms = f"lambda w: coalesce({_map(compare.SYNONYMS)}[w], w)"
    return f"list_transform(list_transform(list_transform({split}, lambda w: {one}), {synonyms}), {synonyms})"


def _bare(tokens: str, entity: str) -> str:
    own = " OR ".join(f"({entity} = '{k}' AND {tokens}[1] IN ({', '.join(f"'{w}'" for w in v)}))" for k, v in compare.PREFIXES.items())
    return f"CASE WHEN len({tokens}) > 1 AND ({own}) THEN {tokens}[2:] ELSE {tokens} END"


def _score(a: str, b: str) -> str:
    generic = _list(compare.GENERIC)
    weight = lambda x: f"list_sum(list_transform({x}, lambda w: CASE WHEN list_contains({generic}, w) THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END))"
    a, b = f"list_distinct({a})", f"list_distinct({b})"
    both, either = f"list_intersect({a}, {b})", f"list_distinct(list_concat({a}, {b}))"
    jaccard = f"{weight(both)} / {weight(either)}"
    mean = f"CASE WHEN len(list_filter({both}, lambda w: NOT list_contains({generic}, w))) > 0 THEN ({jaccard} + {weight(both)} / least({weight(a)}, {weight(b)})) / 2 ELSE {jaccard} END"
    return f"CASE WHEN len({both}) = 0 THEN 0.0::DOUBLE WHEN len({both}) = len({a}) AND len({both}) = len({b}) THEN 1.0::DOUBLE ELSE round_even(({mean}) * 100, 0) / 100 END"


_PAIRS = f"SELECT DISTINCT {_NAME} AS a, {_pick('p_partkey % 9', ['account_number', 'email', 'start_date', 'first_name', '', 'billing_region', 'organization', 'bus status', 'companyNames'])} AS b FROM part"
Q["m01_name_score"] = lambda s, d: _from("part", _PAIRS)(s, d).select("a", "b", compare.name_score(compare.words(F.col("a")), compare.words(F.col("b"))).alias("score"))
SQL["m01_name_score"] = f"SELECT a, b, {_score('x', 'y')} AS score FROM (SELECT a, b, {_words('a')} AS x, {_words('b')} AS y FROM ({_PAIRS}))"
_CATALOG = _values([(k, *k.split(".", 1), f.kind, "yes" if f.required else "no", f.pattern, None if f.max_length is None else str(f.max_length)) for k, f in CONTRACT.items()], "target, entity, field, kind, required, pattern, longest")
_ENTITY = lambda name: f"list_filter(list_transform({_words(rf"regexp_replace({name}, '\.[^.]*$', '')")}, lambda w: {_map(compare.ENTITY_WORDS)}[w]), lambda w: w IS NOT NULL)[1]"
_PARTS = lambda c: f"regexp_extract_all(lower({c}), '[a-z0-9]+')"
_CANDIDATES = f"""SELECT *, row_number() OVER (PARTITION BY dataset, source_field ORDER BY in_entity DESC, score DESC, target) AS place FROM
(SELECT dataset, source_field, own_entity, target, entity, field, own_entity IS NULL OR own_entity = entity AS in_entity, greatest({_score('mine', 'bare_b')}, {_score('mine', 'b')}) AS score FROM
(SELECT *, {_bare('a', 'own_entity')} AS mine, {_bare('b', 'entity')} AS bare_b FROM
(SELECT dataset, source_field, {_ENTITY('dataset')} AS own_entity, {_words('source_field')} AS a FROM ({_FIELDS})) AS f,
(SELECT target, entity, field, {_words('field')} AS b FROM {_CATALOG}) AS t WHERE len(list_intersect(a, b)) > 0)) WHERE score >= CASE WHEN in_entity THEN 0.4::DOUBLE ELSE 0.6::DOUBLE END"""
_FACT_SQL = f"({_FACTS})"
_FIT = """CASE WHEN inferred_type IS NULL THEN 'ok' WHEN inferred_type = 'empty' OR kind = 'enum' THEN 'incompatible'
WHEN kind IN ('date', 'datetime') THEN CASE WHEN inferred_type NOT IN ('date', 'datetime') THEN 'incompatible' WHEN CAST(date_formats AS INT) > 1 OR CAST(iso_pct AS DOUBLE) < 100 OR CAST(malformed AS INT) > 0 OR inferred_type <> kind THEN 'transform' ELSE 'ok' END
WHEN kind IN ('integer', 'decimal') THEN CASE WHEN inferred_type NOT IN ('integer', 'decimal') THEN 'incompatible' WHEN inferred_type = 'decimal' AND kind = 'integer' THEN 'transform' ELSE 'ok' END
WHEN kind = 'boolean' THEN 'incompatible' WHEN kind = 'url' THEN 'incompatible' WHEN kind = 'list' THEN 'transform'
WHEN kind = 'email' THEN CASE WHEN inferred_type <> 'email' THEN 'incompatible' WHEN CAST(malformed AS INT) + CAST(uppercase AS INT) > 0 THEN 'transform' ELSE 'ok' END
WHEN inferred_type = 'phone' THEN CASE WHEN CAST(non_null AS INT) > 0 OR CAST(malformed AS INT) > 0 THEN 'transform' ELSE 'ok' END
WHEN CAST(max_length AS INT) > CAST(longest AS INT) THEN 'transform' ELSE 'ok' END"""
_JUDGED = f"SELECT c.*, {_FIT} AS fit FROM ({_CANDIDATES}) AS c JOIN (SELECT target, kind, longest FROM {_CATALOG}) AS k USING (target) LEFT JOIN {_FACT_SQL} AS f ON f.dataset = c.dataset AND f.source_field = c.source_field"
_CLASSES = f"""SELECT dataset, source_field, CASE WHEN settled THEN CASE fit WHEN 'incompatible' THEN 'incompatible' WHEN 'transform' THEN 'transformation_required' ELSE 'matched' END WHEN n > 0 THEN 'ambiguous' ELSE 'unmapped' END AS class, CASE WHEN settled THEN best_target END AS target FROM
(SELECT *, coalesce(best >= 0.7::DOUBLE AND (second < 0.7::DOUBLE OR best - second >= 0.25::DOUBLE) AND (own_entity IS NOT NULL OR strong = 1), false) AS settled FROM ({_FIELDS}) AS f LEFT JOIN
(SELECT dataset, source_field, count(*) AS n, max(own_entity) AS own_entity, max(target) FILTER (WHERE in_entity AND place = 1) AS best_target, max(score) FILTER (WHERE in_entity AND place = 1) AS best, max(fit) FILTER (WHERE in_entity AND place = 1) AS fit,
coalesce(max(score) FILTER (WHERE in_entity AND place = 2), 0) AS second, count(DISTINCT entity) FILTER (WHERE in_entity AND score >= 0.7::DOUBLE) AS strong FROM ({_JUDGED}) GROUP BY dataset, source_field) AS b USING (dataset, source_field))"""
Q["m02_candidates"] = lambda s, d: _candidates(s, d).select("dataset", "source_field", "own_entity", "target", "in_entity", "score", "match", "place", "compatibility")
SQL["m02_candidates"] = f"SELECT dataset, source_field, own_entity, target, in_entity, score, CASE WHEN score < 1 THEN 'partial' WHEN {_PARTS('source_field')} = {_PARTS('field')} THEN 'exact' ELSE 'synonym' END AS match, place, fit AS compatibility FROM ({_JUDGED})"
Q["m03_classify"] = lambda s, d: _classes(s, d)
SQL["m03_classify"] = _CLASSES
Q["m04_coverage"] = lambda s, d: compare.coverage(_classes(s, d), _candidates(s, d), catalog(s))
_LISTED = lambda k: f"coalesce(string_agg(field, ',' ORDER BY field) FILTER (WHERE held = {k}), '')"
SQL["m04_coverage"] = f"""WITH c AS MATERIALIZED ({_CLASSES}), j AS ({_CANDIDATES}),
h AS (SELECT target, max(held) AS held FROM (SELECT target, 2 AS held FROM c WHERE class IN ('matched', 'transformation_required') UNION ALL SELECT j.target, 1 FROM j JOIN c ON c.dataset = j.dataset AND c.source_field = j.source_field WHERE c.class = 'ambiguous' AND in_entity AND place <= 5) GROUP BY target)
SELECT entity, count(*) AS required, {_N("held = 2")} AS covered, {_LISTED(1)} AS candidate_only, {_LISTED(0)} AS missing FROM
(SELECT k.entity, field, coalesce(held, 0) AS held FROM {_CATALOG} AS k LEFT JOIN h ON h.target = k.target WHERE required = 'yes' AND k.entity IN (SELECT {_ENTITY('dataset')} FROM c)) GROUP BY entity"""
Q["m07_class_counts"] = lambda s, d: compare.class_counts(_classes(s, d))
SQL["m07_class_counts"] = f"SELECT class, count(*) AS n FROM ({_CLASSES}) GROUP BY class"
_GOLDEN_M = "SELECT 'f' || CAST(p_partkey AS STRING) AS source_field, CASE WHEN p_partkey % 4 > 0 THEN 'contact.email' END AS expected FROM part"
_PROPOSED_M = """SELECT 'f' || CAST(p_partkey + CASE WHEN p_partkey % 13 = 0 THEN 10000000 WHEN p_partkey % 17 = 0 THEN 1 ELSE 0 END AS STRING) AS source_field,
CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'organization.name' WHEN 2 THEN 'contact.nowhere' ELSE 'contact.email' END AS target FROM part WHERE p_partkey % 9 > 0"""
Q["m05_check_proposal"] = lambda s, d: compare.check_proposal(_from("part", _PROPOSED_M)(s, d), _from("part", _GOLDEN_M)(s, d), catalog(s))
SQL["m05_check_proposal"] = f"""SELECT 'missing_field' AS problem, source_field AS name FROM ({_GOLDEN_M}) WHERE source_field NOT IN (SELECT source_field FROM ({_PROPOSED_M}))
UNION ALL SELECT DISTINCT 'unknown_field', source_field FROM ({_PROPOSED_M}) WHERE source_field NOT IN (SELECT source_field FROM ({_GOLDEN_M}))
UNION ALL SELECT 'duplicate_field', source_field FROM ({_PROPOSED_M}) GROUP BY source_field HAVING count(*) > 1
UNION ALL SELECT DISTINCT 'unknown_target', target FROM ({_PROPOSED_M}) WHERE target = 'contact.nowhere'"""
_BEFORE = """SELECT p_brand AS dataset, CAST(p_partkey AS STRING) AS source_field, 't' || CAST(p_size AS STRING) AS target, CASE p_partkey % 5 WHEN 0 THEN 'approved' WHEN 1 THEN 'ignored' WHEN 2 THEN 'needs_clarification' ELSE 'suggested' END AS status,
'names' AS origin, 0.5D AS confidence, CASE WHEN p_partkey % 5 < 2 THEN 'ann' END AS decided_by FROM part WHERE p_partkey % 3 > 0"""
_OFFERED = """SELECT p_brand AS dataset, CAST(p_partkey AS STRING) AS source_field, CASE WHEN p_partkey % 7 > 0 THEN 'n' || CAST(p_size AS STRING) END AS target, 'model' AS origin, (p_partkey % 10) / 10.0D AS confidence, p_partkey % 8 = 0 AS asks,
CASE WHEN p_partkey % 16 = 0 THEN 'which one' END AS question FROM part WHERE p_partkey % 4 > 0 OR p_partkey % 16 < 8"""
_PROFILED = "SELECT p_brand AS dataset, CAST(p_partkey AS STRING) AS source_field FROM part WHERE p_partkey % 11 > 0"
_QUESTIONS = "SELECT p_brand AS dataset, CAST(p_partkey AS STRING) AS source_field, CASE WHEN p_partkey % 2 = 0 THEN 'open' ELSE 'answered' END AS status, 'old' AS question FROM part WHERE p_partkey % 5 = 2"


def _upserted(s: SparkSession, d: str, force: bool) -> DataFrame:
    """Mappings and questions as one table of rows."""
    frames = [_from("part", sql)(s, d) for sql in (_BEFORE, _OFFERED, _PROFILED, _QUESTIONS)]
    mappings, questions = review.upsert(*frames, force=force)
    rows = mappings.select(F.lit("mapping").alias("what"), "dataset", "source_field", "target", "status", "origin", "confidence", "decided_by", "written", "kept")
    asked = questions.select(F.lit("question").alias("what"), "dataset", "source_field", F.col("question").alias("target"), "status")
    return rows.unionByName(asked, allowMissingColumns=True)


def _upsert_sql(force: bool) -> str:
    b, o, q = (x.replace("0.5D", "CAST(0.5 AS DOUBLE)").replace("10.0D", "CAST(10 AS DOUBLE)") for x in (_BEFORE, _OFFERED, _QUESTIONS))
    settled = f"coalesce(b.status IN ('approved', 'rejected', 'ignored') OR (b.status = 'needs_clarification' AND EXISTS (SELECT 1 FROM q WHERE q.dataset = b.dataset AND q.source_field = b.source_field AND q.status = 'open')), false) AND NOT {str(force).lower()}"
    again = f"{str(force).lower()} AND q.status = 'open' AND EXISTS (SELECT 1 FROM j WHERE j.written AND j.had AND j.dataset = q.dataset AND j.source_field = q.source_field)"
    return f"""WITH b AS ({b}), o AS (SELECT * FROM ({o}) WHERE (dataset, source_field) IN ({_PROFILED})), q AS ({q}),
j AS (SELECT coalesce(b.dataset, o.dataset) AS dataset, coalesce(b.source_field, o.source_field) AS source_field, b.dataset IS NOT NULL AS had, o.dataset IS NOT NULL AND NOT ({settled}) AS written, o.dataset IS NOT NULL AND {settled} AS kept,
  b.target AS bt, b.status AS bs, b.origin AS bo, b.confidence AS bc, b.decided_by AS bd, o.target AS nt, o.origin AS no, o.confidence AS nc, o.asks, o.question FROM b FULL JOIN o ON o.dataset = b.dataset AND o.source_field = b.source_field)
SELECT 'mapping' AS what, dataset, source_field, CASE WHEN written THEN nt ELSE bt END AS target, CASE WHEN NOT written THEN bs WHEN asks THEN 'needs_clarification' ELSE 'suggested' END AS status,
  CASE WHEN written THEN no ELSE bo END AS origin, CASE WHEN written THEN nc ELSE bc END AS confidence, CASE WHEN NOT written THEN bd END AS decided_by, written, kept FROM j
UNION ALL SELECT 'question', dataset, source_field, question, CASE WHEN {again} THEN 'withdrawn' ELSE status END, NULL, NULL, NULL, NULL, NULL FROM q
UNION ALL SELECT 'question', dataset, source_field, coalesce(question, 'What is ' || source_field || '?'), 'open', NULL, NULL, NULL, NULL, NULL FROM j WHERE written AND asks"""


for _force in (False, True):
    Q[f"m08_upsert{'_by_force' if _force else ''}"] = lambda s, d, force=_force: _upserted(s, d, force)
    SQL[f"m08_upsert{'_by_force' if _force else ''}"] = _upsert_sql(_force)
_SURE = "SELECT o.dataset, o.source_field, o.target, CASE WHEN CAST(o.source_field AS INT) % 6 = 0 THEN 'approved' ELSE 'suggested' END AS status, o.confidence, o.asks, CAST(NULL AS STRING) AS decided_by FROM (" + _OFFERED + ") o"
Q["m09_bulk_approve"] = lambda s, d: review.bulk_approve(_from("part", _SURE)(s, d), "ann", 0.5, floor=0.7)
SQL["m09_bulk_approve"] = f"""SELECT dataset, source_field, target, confidence, asks, CASE WHEN bulk = 'approved' THEN 'approved' ELSE status END AS status, CASE WHEN bulk = 'approved' THEN 'ann' END AS decided_by, bulk
FROM (SELECT *, CASE WHEN status = 'suggested' AND target IS NOT NULL THEN CASE WHEN confidence >= 0.7::DOUBLE AND NOT asks THEN 'approved' ELSE 'skipped' END END AS bulk FROM ({_SURE.replace("10.0D", "CAST(10 AS DOUBLE)")}))"""
_PROPOSED_ONCE = f"SELECT source_field, max(target) AS target FROM ({_PROPOSED_M}) AS p GROUP BY source_field"
Q["m06_eval_score"] = lambda s, d: compare.score_mappings(_from("part", _GOLDEN_M)(s, d), _from("part", _PROPOSED_ONCE)(s, d))
SQL["m06_eval_score"] = f"""SELECT count(*) AS fields, {_N("target IS NOT DISTINCT FROM expected")} AS correct, {_N("target IS NULL AND expected IS NOT NULL")} AS unresolved, {_N("target IS NOT NULL AND target IS DISTINCT FROM expected")} AS wrong,
round_even({_N("target IS NOT DISTINCT FROM expected")} / CAST(count(*) AS DOUBLE), 4) AS accuracy FROM ({_GOLDEN_M}) AS g LEFT JOIN ({_PROPOSED_ONCE}) AS p ON p.source_field = g.source_field"""

_ISSUES = """SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'contact' ELSE 'subscription' END AS entity, o_orderstatus AS dataset, o_custkey AS source_row, CASE WHEN o_orderkey % 4 = 0 THEN 'warning' ELSE 'error' END AS severity,
CASE o_orderkey % 5 WHEN 0 THEN 'unmapped_value' WHEN 1 THEN 'missing_required' WHEN 2 THEN 'parent_record_rejected' WHEN 3 THEN 'date_in_future' ELSE 'business_rule_violation' END AS error_type, o_orderpriority AS field FROM orders"""
_KEY = "entity, severity, error_type"
_GROUPS = f"""SELECT {_KEY}, issues, records, fields FROM (SELECT {_KEY}, count(*) AS issues, count(DISTINCT (dataset, source_row)) AS records FROM ({_ISSUES}) GROUP BY {_KEY})
JOIN (SELECT {_KEY}, string_agg(field, ',' ORDER BY r) AS fields FROM (SELECT {_KEY}, field, row_number() OVER (PARTITION BY {_KEY} ORDER BY count(*) DESC, field) AS r FROM ({_ISSUES}) GROUP BY {_KEY}, field) WHERE r <= 4 GROUP BY {_KEY}) USING ({_KEY})"""
_issues = _from("orders", _ISSUES)
Q["g01_issue_groups"] = lambda s, d: readiness.issue_groups(_issues(s, d))
SQL["g01_issue_groups"] = _GROUPS
Q["g02_gates"] = lambda s, d: readiness.gates(Q["k05_coverage"](s, d), Q["k02_checks"](s, d), 1)
SQL["g02_gates"] = f"""WITH g AS (SELECT 'coverage:' || entity AS gate,
  CASE WHEN CASE WHEN built = skipped THEN 1.0 ELSE CAST(accepted AS DOUBLE) / (built - skipped) END < 0.95 THEN 'BLOCKER' WHEN built - skipped - accepted > 0 THEN 'CONDITION' ELSE 'PASS' END AS state FROM ({_LEDGER})
UNION ALL SELECT 'reconciliation', CASE WHEN (SELECT count(*) > 0 AND bool_and(ok) FROM ({SQL["k02_checks"]})) THEN 'PASS' ELSE 'BLOCKER' END UNION ALL SELECT 'warnings', 'CONDITION')
SELECT gate, state FROM g UNION ALL SELECT 'verdict', CASE WHEN bool_or(state = 'BLOCKER') THEN 'BLOCKED' WHEN bool_or(state = 'CONDITION') THEN 'READY WITH CONDITIONS' ELSE 'READY' END FROM g"""
Q["g03_work_items"] = lambda s, d: readiness.work_items(readiness.issue_groups(_issues(s, d)))
SQL["g03_work_items"] = f"""SELECT entity, error_type, CASE error_type WHEN 'unmapped_value' THEN 'decision' WHEN 'business_rule_violation' THEN 'decision' WHEN 'missing_required' THEN 'data_fix' WHEN 'parent_record_rejected' THEN 'dependent' ELSE 'review' END AS kind,
severity = 'error' AS blocking, records FROM ({_GROUPS})"""
Q["g04_normalization_counts"] = lambda s, d: readiness.normalization_counts(rec.c.Q["c16_country_code"](s, d).select(F.array_compact(F.array("note")).alias("notes")))
SQL["g04_normalization_counts"] = f"SELECT regexp_replace(note, '''[^'']*''', '''...''', 'g') AS note, count(*) AS n FROM ({CONVERTED['c16_country_code']}) WHERE note IS NOT NULL GROUP BY 1 ORDER BY n DESC, 1 LIMIT 25"
Q["g05_issue_counts"] = lambda s, d: readiness.issue_counts(_issues(s, d))
SQL["g05_issue_counts"] = f"SELECT severity, error_type, count(*) AS n FROM ({_ISSUES}) GROUP BY severity, error_type UNION ALL SELECT severity, NULL, count(*) FROM ({_ISSUES}) GROUP BY severity"
Q["g06_issue_breakdown"] = lambda s, d: readiness.issue_breakdown(_issues(s, d))
SQL["g06_issue_breakdown"] = f"""WITH i AS ({_ISSUES}), p AS (SELECT *, row_number() OVER (PARTITION BY entity, error_type, field ORDER BY source_row, dataset) AS n FROM (SELECT DISTINCT entity, error_type, field, source_row, dataset FROM i))
SELECT * FROM (SELECT entity, error_type, field, count(*) AS issues, count(DISTINCT (dataset, source_row)) AS records FROM i GROUP BY ALL)
JOIN (SELECT entity, error_type, field, string_agg(dataset || ':' || CAST(source_row AS VARCHAR), ',' ORDER BY source_row, dataset) AS examples FROM p WHERE n <= 3 GROUP BY ALL) USING (entity, error_type, field)"""


def _store(s: SparkSession, name: str) -> Store:
    return Store(s, f"{shared_folder(s)}/{name}-{uuid.uuid4().hex}")


def _page(found: tuple[DataFrame, int]) -> DataFrame:
    return found[0].withColumn("total", F.lit(found[1]).cast("long"))


def _issue_page(s: SparkSession, d: str) -> DataFrame:
    store = _store(s, "issues")
    readiness.store_issues(store, _issues(s, d), 0)
    return _page(store.page(50, 100, entity="contact", severity="error"))


def _failure_page(s: SparkSession, d: str) -> DataFrame:
    store = _store(s, "failures")
    readiness.store_failures(store, _from("orders", _FAILED)(s, d), 0)
    return _page(store.page(200, 400, entity="O"))


def _mapping_list(s: SparkSession, d: str) -> DataFrame:
    store = _store(s, "mappings")
    readiness.store_mappings(store, _from("part", _MAPPED)(s, d), 0)
    return _page(store.page(60, 30, status="approved"))


_UNNAMED = f"SELECT * REPLACE (CASE WHEN source_row % 9 = 0 THEN NULL ELSE field END AS field) FROM ({_ISSUES})"
Q["g15_issue_overview"] = lambda s, d: readiness.issue_overview(_issues(s, d).withColumn("field", F.when(F.col("source_row") % 9 != 0, F.col("field"))))
SQL["g15_issue_overview"] = f"""SELECT entity, severity, error_type, n AS count, coalesce(fields, '') AS fields FROM (SELECT {_KEY}, count(*) AS n FROM ({_UNNAMED}) GROUP BY ALL)
LEFT JOIN (SELECT {_KEY}, string_agg(field, ',' ORDER BY r) AS fields FROM (SELECT {_KEY}, field, row_number() OVER (PARTITION BY {_KEY} ORDER BY count(*) DESC, field) AS r FROM ({_UNNAMED}) WHERE field IS NOT NULL GROUP BY {_KEY}, field) WHERE r <= 5 GROUP BY {_KEY}) USING ({_KEY})"""
Q["g07_issue_page"] = _issue_page
SQL["g07_issue_page"] = f"SELECT *, count(*) OVER () AS total FROM ({_ISSUES}) WHERE entity = 'contact' AND severity = 'error' ORDER BY entity, dataset, source_row, error_type, field LIMIT 50 OFFSET 100"
_FAILED = "SELECT o_orderstatus AS entity, CAST(o_orderkey AS STRING) AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'timeout' ELSE 'target_unavailable' END AS error_type FROM orders WHERE o_orderkey % 4 = 0"
Q["g13_failure_page"] = _failure_page
SQL["g13_failure_page"] = f"SELECT *, count(*) OVER () AS total FROM ({_FAILED}) WHERE entity = 'O' ORDER BY entity, id LIMIT 200 OFFSET 400"
_MAPPED = "SELECT p_brand AS dataset, p_partkey AS position, 'f' || CAST(p_partkey AS STRING) AS source_field, CASE p_partkey % 5 WHEN 0 THEN 'suggested' ELSE 'approved' END AS status FROM part"
Q["g14_mapping_list"] = _mapping_list
SQL["g14_mapping_list"] = f"SELECT *, count(*) OVER () AS total FROM ({_MAPPED}) WHERE status = 'approved' ORDER BY dataset, position, source_field LIMIT 60 OFFSET 30"
_DECIDED = "SELECT CAST(p_partkey AS STRING) AS source_field, CASE p_partkey % 5 WHEN 0 THEN 'rejected' WHEN 1 THEN 'ignored' ELSE 'approved' END AS status FROM part"
_OPEN = "SELECT s_suppkey AS question, s_suppkey < 0 AS open FROM supplier"
_LATEST = f"SELECT false AS partial, 'p1' AS plan, 'c1' AS config, {_N("o_orderkey % 7 = 0")} AS rejected, {_N("o_orderkey < 0")} AS failed FROM orders"


def _all_gates(s: SparkSession, d: str) -> DataFrame:
    decided = readiness.decision_gate(_from("part", _DECIDED)(s, d), _from("supplier", _OPEN)(s, d))
    rehearsed = readiness.rehearsal_gates(_from("orders", _LATEST)(s, d), "p1", "c2")
    return readiness.verdict(decided.union(rehearsed).union(Q["g02_gates"](s, d).where("gate <> 'verdict'")))


Q["g08_all_gates"] = _all_gates
SQL["g08_all_gates"] = f"""WITH g AS (SELECT 'mappings_decided' AS gate, CASE WHEN EXISTS (SELECT 1 FROM ({_DECIDED}) WHERE status NOT IN ('approved', 'rejected', 'ignored')) OR EXISTS (SELECT 1 FROM ({_OPEN}) WHERE open) THEN 'BLOCKER' ELSE 'PASS' END AS state
UNION ALL SELECT 'rehearsal', CASE WHEN partial THEN 'BLOCKER' ELSE 'PASS' END FROM ({_LATEST}) UNION ALL SELECT 'rehearsal_current', CASE WHEN plan = 'p1' AND config = 'c2' THEN 'PASS' ELSE 'BLOCKER' END FROM ({_LATEST})
UNION ALL SELECT 'target_accepted', CASE WHEN rejected + failed > 0 THEN 'BLOCKER' ELSE 'PASS' END FROM ({_LATEST}) UNION ALL SELECT * FROM ({SQL["g02_gates"]}) WHERE gate <> 'verdict')
SELECT gate, state FROM g UNION ALL SELECT 'verdict', CASE WHEN bool_or(state = 'BLOCKER') THEN 'BLOCKED' WHEN bool_or(state = 'CONDITION') THEN 'READY WITH CONDITIONS' ELSE 'READY' END FROM g"""
_KNOWN_FIELDS = """SELECT p_brand AS dataset, CAST(p_partkey AS STRING) AS source_field, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE 't' || CAST(p_size % 3 AS STRING) END AS expected,
p_partkey % 7 = 0 AS clarify, p_partkey % 3 = 0 AS clarify_ok, p_partkey % 8 < 3 AS transformation FROM part"""
_RUNS = """SELECT p_brand AS dataset, CAST(p_partkey AS STRING) AS source_field, r AS run, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE 't' || CAST((p_size + CASE WHEN p_partkey % 11 = r THEN 1 ELSE 0 END) % 3 AS STRING) END AS target,
p_partkey % 6 = 0 AS asks, (p_partkey % 10) / 10.0D AS confidence, p_partkey % 9 < 5 AS transforms FROM part"""


def _golden(s: SparkSession, d: str) -> DataFrame:
    return _from("part", _KNOWN_FIELDS)(s, d).withColumn("accept", F.array(F.lit("t2")))


def _proposed(s: SparkSession, d: str, run: int) -> DataFrame:
    return _from("part", _RUNS.replace("r AS run", f"{run} AS run").replace("= r THEN", f"= {run} THEN"))(s, d).where("cast(source_field as int) % 13 <> 0")


def _judged_runs(s: SparkSession, d: str) -> DataFrame:
    out = None
    for run in range(3):
        own = evaluation.judge(_golden(s, d), _proposed(s, d, run)).withColumn("run", F.lit(run))
        out = own if out is None else out.unionByName(own)
    return out


def _judge_sql(run: int) -> str:
    proposed = _RUNS.replace("r AS run", f"{run} AS run").replace("= r THEN", f"= {run} THEN").replace("10.0D", "CAST(10 AS DOUBLE)")
    return f"""SELECT g.dataset, g.source_field, expected, clarify, clarify_ok, transformation, target AS proposed, coalesce(asks, false) AS asks, coalesce(transforms, false) AS transforms, coalesce(confidence, 0) AS confidence, {run} AS run,
CASE WHEN p.source_field IS NULL THEN 'unresolved'
WHEN clarify THEN CASE WHEN asks AND coalesce(target, 't2') = 't2' THEN 'correct' WHEN target = 't2' THEN 'overconfident' ELSE 'wrong' END
WHEN expected IS NULL THEN CASE WHEN coalesce(target, 't2') = 't2' THEN 'correct' ELSE 'wrong' END
WHEN target = expected OR target = 't2' THEN 'correct' WHEN target IS NOT NULL THEN 'wrong' WHEN asks AND clarify_ok THEN 'correct' WHEN asks THEN 'deferred' ELSE 'unresolved' END AS outcome
FROM ({_KNOWN_FIELDS}) AS g LEFT JOIN (SELECT * FROM ({proposed}) WHERE CAST(source_field AS INT) % 13 <> 0) AS p ON p.dataset = g.dataset AND p.source_field = g.source_field"""


_JUDGED_RUNS = " UNION ALL ".join(_judge_sql(r) for r in range(3))
_RIGHT, _TARGETED, _CHANGED = "outcome = 'correct'", "expected IS NOT NULL", "transformation AND outcome = 'correct' AND proposed IS NOT NULL"


def _part(some: str, of: str) -> str:
    return f"round_even({_N(f'({some}) AND ({of})')} / CAST(nullif({_N(of)}, 0) AS DOUBLE), 3)"


_METRICS = f"""count(*) AS fields, {", ".join(f"{_N(f"outcome = '{o}'")} AS {o}" for o in evaluation.OUTCOMES)}, {_part(_RIGHT, "true")} AS accuracy,
{_N(_TARGETED)} AS target_fields, {_N(f"{_TARGETED} AND {_RIGHT}")} AS target_correct, {_part(_RIGHT, _TARGETED)} AS target_accuracy,
{_N("clarify")} AS clarify_expected, {_N("clarify AND asks")} AS clarify_flagged, {_part("asks", "clarify")} AS clarification_recall,
{_N("asks AND NOT clarify AND NOT clarify_ok")} AS clarification_false_positives, {_part("transforms", _CHANGED)} AS transformation_flag_recall,
{_N("outcome IN ('wrong', 'overconfident') AND confidence >= 0.9")} AS incorrect_high_confidence,
round_even(avg(confidence) FILTER (WHERE {_RIGHT}), 3) AS mean_confidence_correct, round_even(avg(confidence) FILTER (WHERE outcome IN ('wrong', 'overconfident')), 3) AS mean_confidence_incorrect"""
Q["e01_judge"] = lambda s, d: evaluation.judge(_golden(s, d), _proposed(s, d, 0)).withColumn("run", F.lit(0))
SQL["e01_judge"] = _judge_sql(0)
Q["e02_metrics"] = lambda s, d: evaluation.metrics(_judged_runs(s, d), "run")
SQL["e02_metrics"] = f"SELECT run, {_METRICS} FROM ({_JUDGED_RUNS}) GROUP BY run"
Q["e03_series"] = lambda s, d: evaluation.series(_judged_runs(s, d))
SQL["e03_series"] = f"""SELECT metric, min(value) AS least, max(value) AS most, round_even(avg(value), 3) AS mean
FROM (UNPIVOT (SELECT run, {", ".join(f"CAST({m} AS DOUBLE) AS {m}" for m in evaluation.SERIES)} FROM (SELECT run, {_METRICS} FROM ({_JUDGED_RUNS}) GROUP BY run))
ON COLUMNS(* EXCLUDE run) INTO NAME metric VALUE value) GROUP BY metric"""
Q["e04_unstable_fields"] = lambda s, d: evaluation.unstable_fields(_judged_runs(s, d))
SQL["e04_unstable_fields"] = f"SELECT dataset, source_field, string_agg(outcome, ',' ORDER BY outcome) AS outcomes FROM (SELECT DISTINCT dataset, source_field, outcome FROM ({_JUDGED_RUNS})) GROUP BY ALL HAVING count(*) > 1"
Q["g09_next_steps"] = lambda s, d: readiness.next_steps(_all_gates(s, d), readiness.work_items(readiness.issue_groups(_issues(s, d))), 2)
SQL["g09_next_steps"] = f"""WITH g AS ({SQL["g08_all_gates"]}), w AS ({SQL["g03_work_items"]}), b AS (SELECT gate FROM g WHERE state = 'BLOCKER'), v AS (SELECT state FROM g WHERE gate = 'verdict')
SELECT 0 AS place, 'decide the open fields and questions' AS step, CAST(NULL AS BIGINT) AS records WHERE 'mappings_decided' IN (FROM b)
UNION ALL SELECT 1, 'rehearse the whole current plan', NULL WHERE 'rehearsal' IN (FROM b) OR 'rehearsal_current' IN (FROM b) UNION ALL SELECT 2, 'explain what does not reconcile', NULL WHERE 'reconciliation' IN (FROM b)
UNION ALL SELECT 3, 'look into what the target refused', NULL WHERE 'target_accepted' IN (FROM b) UNION ALL SELECT 4, 'ask the customer', {_N("kind = 'decision'")} + 2 FROM w
UNION ALL SELECT 5, 'have data corrected', CAST(sum(records) AS BIGINT) FROM w WHERE kind = 'data_fix' HAVING count(*) > 0 UNION ALL SELECT 6, 'expect dependent records after that', CAST(sum(records) AS BIGINT) FROM w WHERE kind = 'dependent' HAVING sum(records) > 0
UNION ALL SELECT 7, 'rehearse the corrected export', NULL FROM w WHERE kind IN ('decision', 'data_fix') HAVING count(*) > 0
UNION ALL SELECT 8, 'get the sign-off on what stays behind', NULL WHERE (SELECT state FROM v) <> 'BLOCKED' UNION ALL SELECT 9, 'agree on a date', NULL WHERE (SELECT state FROM v) <> 'BLOCKED'"""
_SAYINGS = "SELECT CAST(p_partkey AS STRING) AS part, 'kept ' || CAST(p_size AS STRING) || ' of 1,000 and ' || CAST(p_partkey AS STRING) || '.' AS text FROM part"
_FACTS_SAID = "SELECT 'size ' || CAST(p_size AS STRING) || ', 1000 in all' AS text FROM part WHERE p_partkey % 2 = 0"
Q["g10_unfounded_numbers"] = lambda s, d: readiness.unfounded_numbers(_from("part", _SAYINGS)(s, d), _from("part", _FACTS_SAID)(s, d))
SQL["g10_unfounded_numbers"] = f"""WITH k AS (SELECT DISTINCT CAST(p_size AS VARCHAR) AS n FROM part WHERE p_partkey % 2 = 0 UNION SELECT '1000')
SELECT DISTINCT part, number FROM (SELECT CAST(p_partkey AS VARCHAR) AS part, unnest([CAST(p_size AS VARCHAR), CAST(p_partkey AS VARCHAR)]) AS number FROM part) WHERE number NOT IN (FROM k)"""
_HISTORY = """SELECT o_orderkey AS id, o_orderpriority AS kind, CASE WHEN o_orderkey % 3 = 0 THEN 'running' ELSE 'completed' END AS status, CAST(o_orderdate AS TIMESTAMP) AS started_at, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderdate AS TIMESTAMP) + INTERVAL '1' DAY END AS heartbeat_at FROM orders"""
_NOW = "1996-01-01 00:00:00"
Q["g11_latest_runs"] = lambda s, d: readiness.latest(_from("orders", _HISTORY)(s, d), "kind").select("kind", "id", "status")
SQL["g11_latest_runs"] = f"SELECT kind, id, status FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY started_at DESC, id DESC) AS n FROM ({_HISTORY})) WHERE n = 1"
Q["g12_stalled_runs"] = lambda s, d: readiness.stalled(_from("orders", _HISTORY)(s, d), _NOW).select("id")
SQL["g12_stalled_runs"] = f"SELECT id FROM ({_HISTORY}) WHERE status = 'running' AND coalesce(heartbeat_at, started_at) < TIMESTAMP '{_NOW}' - INTERVAL 600 SECONDS"
Q["s04_synthetic"] = lambda s, d: organizations(s, view(s, d, "customer").count(), seed=3)[0]

_NOTES = """SELECT o_orderkey, CAST(o_orderkey AS STRING) AS id, CASE WHEN o_orderkey % 11 = 0 THEN '' WHEN o_orderkey % 7 = 0 THEN 'said "' || o_orderpriority || '",' || chr(10) || 'then ' || chr(125) || chr(123) || ' "' || CAST(o_custkey AS STRING) || '"'
WHEN o_orderkey % 5 = 0 THEN o_orderstatus || ', ' || o_orderpriority ELSE o_orderpriority END AS note, CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_custkey AS STRING) END AS customer FROM orders"""


def _as_list(batches):
    """The objects of a task as one JSON list under `data`, batch by batch."""
    before = '{"page": {"size": 1}, "data": ['
    for batch in batches:
        texts = batch.column(0).to_pylist()
        if texts:
            yield pa.RecordBatch.from_pydict({"value": [before, texts[0], *[f", {t}" for t in texts[1:]]]})
            before = ", "
    yield pa.RecordBatch.from_pydict({"value": [*([before] if before != ", " else []), '], "has_more": false}']})


def _exported(s: SparkSession, d: str, kind: str) -> str:
    """The orders as an export of as many files as tasks, in the orders' order from file to file, in a folder of its own."""
    rows = _from("orders", _NOTES)(s, d).repartitionByRange("o_orderkey").sortWithinPartitions("o_orderkey")
    folder = f"{shared_folder(s)}/export-{uuid.uuid4().hex}"
    if kind == "csv":
        rows.drop("o_orderkey").write.csv(folder, header=True, escape='"', emptyValue="", lineSep="\n")
        return folder
    rows.select(F.to_json(F.struct("id", "note", "customer")).alias("value")).mapInArrow(_as_list, "value string").write.text(folder)
    return folder


_EXPORTED = f"SELECT CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS BIGINT) AS row_idx, * EXCLUDE (o_orderkey) FROM ({_NOTES})"
Q["s01_csv_scan"] = lambda s, d: files.read_csv(s, _exported(s, d, "csv"))
SQL["s01_csv_scan"] = f"SELECT * REPLACE (coalesce(customer, '') AS customer) FROM ({_EXPORTED})"
Q["s02_json_scan"] = lambda s, d: files.read_json(s, _exported(s, d, "json"))
SQL["s02_json_scan"] = _EXPORTED


def _stored(s: SparkSession, d: str) -> DataFrame:
    """What a namespace holds after a write and a repeated, partly changed one."""
    store = write.TargetStore(s, f"{shared_folder(s)}/target-{uuid.uuid4().hex}")
    rows = _from("customer", "SELECT CAST(c_custkey AS STRING) AS record_id, c_custkey AS source_row, c_mktsegment AS segment FROM customer")(s, d)
    store.write("organization", "rehearsal", rows.where("source_row % 2 = 0").select("record_id", "source_row", F.struct("segment").alias("payload")))
    store.write("organization", "rehearsal", rows.select("record_id", "source_row", F.struct(F.when(F.col("source_row") % 3 > 0, F.col("segment")).alias("segment")).alias("payload")))
    return store.read("organization", "rehearsal").select("id", F.get_json_object("payload", "$.segment").alias("segment"))


def _record_page(s: SparkSession, d: str) -> DataFrame:
    """A page of what a target holds, by id, of those with one status."""
    store = _store(s, "records")
    store.replace(_from("orders", _HELD_RECORDS)(s, d), 0, ["id"], ("status",))
    return _page(store.page(100, 250, status="F"))


_HELD_RECORDS = "SELECT CAST(o_orderkey AS STRING) AS id, CAST(o_custkey AS STRING) AS organization_id, o_orderstatus AS status FROM orders"
Q["s05_record_page"] = _record_page
SQL["s05_record_page"] = f"SELECT *, count(*) OVER () AS total FROM ({_HELD_RECORDS}) WHERE status = 'F' ORDER BY id LIMIT 100 OFFSET 250"
Q["s03_target_read_back"] = _stored
SQL["s03_target_read_back"] = "SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey % 2 = 0 OR c_custkey % 3 > 0 THEN c_mktsegment END AS segment FROM customer"
