"""Profile queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.catalogue.views import VIEWS, view
from quayside.functions import cells
from quayside.operators import profile as p
from quayside.plans.shared import barrier

AS_OF = "2001-06-01"
Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None) -> None:
    Q[name] = query
    if sql:
        SQL[name] = sql


# --- SQL that states the cascade ---------------------------------------------------------------


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def sql_strip(e: str) -> str:
    return rf"regexp_replace({e}, '^\s+|\s+$', '', 'g')"


def sql_re(e: str, pattern: str) -> str:
    return f"regexp_matches({e}, '{pattern.replace(chr(39), chr(39) * 2)}')"


def sql_time(v: str, fmt: str) -> str:
    """DuckDB's own parser behind the texts that a format reads."""
    duck = fmt.replace("Z", "") if fmt.endswith("Z") else fmt
    text = f"rtrim({v}, 'Z')" if fmt.endswith("Z") else v
    if fmt.endswith("%z"):
        text, duck = rf"regexp_replace({v}, '([+-]\d{{2}}:?\d{{2}}|Z)$', '')", fmt[:-2]
    return f"CASE WHEN {sql_re(v, cells.format_pattern(fmt))} THEN try_strptime({text}, '{duck}') END"


def sql_first(v: str, formats: list[str], label: bool = False) -> str:
    if not label:
        return "coalesce(" + ", ".join(sql_time(v, f) for f in formats) + ")"
    return "CASE " + " ".join(f"WHEN {sql_time(v, f)} IS NOT NULL THEN '{f}'" for f in formats) + " END"


def sql_tag(v: str = "v") -> str:
    digits = rf"regexp_replace({v}, '\D', '', 'g')"
    r = sql_re
    return f"""CASE WHEN {v} IS NULL OR {v} = '' THEN 'blank' WHEN lower({v}) IN ({quoted(cells.PLACEHOLDERS)}) THEN 'placeholder'
      WHEN {r(v, cells.INTEGER)} THEN 'integer' WHEN {r(v, cells.DECIMAL)} THEN 'decimal'
      WHEN contains({v}, '@') THEN CASE WHEN {r(v, cells.EMAIL)} THEN 'email' ELSE 'email_malformed' END
      WHEN {r(v, cells.URL)} THEN 'url' WHEN {r(v, cells.IDENTIFIER)} THEN 'identifier' WHEN {r(v, cells.NUMERIC_TEXT)} THEN 'numeric_text'
      WHEN {r(v, '[0-9]')} AND contains({v}, ':') AND {sql_first(v, cells.DATETIME_FORMATS)} IS NOT NULL THEN 'datetime'
      WHEN {r(v, '[0-9]')} AND {sql_first(v, cells.DATE_FORMATS)} IS NOT NULL THEN 'date'
      WHEN {r(v, cells.PHONE)} THEN CASE WHEN length({digits}) BETWEEN 10 AND 15 THEN 'phone' ELSE 'phone_short' END
      WHEN {r(v, cells.CODE)} THEN 'code' WHEN {r(v, cells.URL_NO_SCHEME)} THEN 'url_no_scheme'
      WHEN contains(lower({v}), ' at ') AND contains({v}, '.') THEN 'email_malformed' ELSE 'text' END"""


def sql_number(v: str = "v") -> str:
    bare = rf"regexp_replace(regexp_replace({v}, '^[A-Z]{{3}}\s', ''), '^[$€£]\s?', '')"
    factor = f"CASE WHEN {sql_re(bare, 'M$')} THEN 1e6 WHEN {sql_re(bare, '[Kk]$')} THEN 1e3 WHEN {sql_re(bare, '[Bb]$')} THEN 1e9 ELSE 1.0 END"
    return rf"CASE WHEN {sql_re(v, cells.INTEGER)} OR {sql_re(v, cells.DECIMAL)} THEN try_cast({v} AS DOUBLE) WHEN {sql_re(v, cells.NUMERIC_TEXT)} THEN try_cast(regexp_replace({bare}, '[,\s%MKkBb]', '', 'g') AS DOUBLE) * {factor} END"


#: Columns and row number of what the queries profile.
SOURCES = {
    "messy_organizations": ("row_idx", ["acct_num", "company_name", "company_status", "industry_code", "hq_state", "country", "website", "annual_revenue", "employee_count", "customer_tier", "primary_contact_email", "created_on", "last_activity_date"]),
    "messy_contacts": ("row_idx", ["contact_ref", "acct_num", "full_name", "contact_mail", "phone_number", "contact_role", "is_primary"]),
    "messy_subscriptions": ("row_idx", ["sub_id", "acct_num", "subscription_level", "billing_freq", "sub_status", "seat_count", "start_dt", "renew_dt", "monthly_amount", "currency"]),
    "messy_activity": ("row_idx", ["activity_id", "acct_num", "activity_type", "occurred_at", "amount", "description"]),
    "customer": ("c_custkey", ["c_name", "c_nationkey", "c_mktsegment"]),
    "orders": ("o_orderkey", ["o_custkey", "o_orderstatus", "o_orderpriority"]),
    "part": ("p_partkey", ["p_name", "p_brand", "p_type", "p_size"]),
    "pages": ("page_id", ["url"]),
    "events": ("event_id", ["user_id", "event_type", "props"]),
}


def values_sql(*sources: str) -> str:
    """WITH list up to vals(src, col, pos, raw, v, tag, n, first) and said, its values that say something."""
    head = [f"{n} AS ({VIEWS[n].strip()})" for n in sources if n in VIEWS]
    cell_rows = [f"SELECT '{s}' AS src, '{c}' AS col, {i} AS pos, CAST({c} AS VARCHAR) AS raw, CAST({SOURCES[s][0]} AS BIGINT) AS r FROM {s}" for s in sources for i, c in enumerate(SOURCES[s][1])]
    return ",\n".join([
        *head,
        "cell AS (" + "\nUNION ALL ".join(cell_rows) + ")",
        f"stripped AS (SELECT src, col, pos, raw, {sql_strip('raw')} AS v, CAST(count(*) AS BIGINT) AS n, min(r) AS first FROM cell GROUP BY ALL)",
        f"vals AS (SELECT *, {sql_tag()} AS tag FROM stripped)",
        "said AS (SELECT src, col, v, any_value(tag) AS tag, CAST(sum(n) AS BIGINT) AS n, min(first) AS first FROM vals WHERE tag NOT IN ('blank', 'placeholder') GROUP BY src, col, v)",
    ])


def values(spark: SparkSession, sf_dir: str, *sources: str, written: bool = True) -> DataFrame:
    """The values of all these tables, written once; not at all for what reads them once."""
    frames = {}
    for s in sources:
        row, columns = SOURCES[s]
        frames[s] = view(spark, sf_dir, s).select(F.col(row).alias("row_idx"), *[c for c in columns if c != row])
    return barrier(p.value_tables(frames), "values") if written else p.value_tables(frames)


def per_source(fn: Callable[[DataFrame], DataFrame], *sources: str, columns: list[str] | None = None, written: bool = True) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = values(spark, sf_dir, *sources, written=written)
        return fn(own.where(F.col("col").isin(columns)) if columns else own)

    return query


def only(columns: list[str]) -> str:
    return f"col IN ({quoted(columns)})"


big = lambda e: f"CAST({e} AS BIGINT)"
n_if = lambda c: f"CAST(coalesce(sum(n) FILTER (WHERE {c}), 0) AS BIGINT)"

add("p01_tag_counts", per_source(p.tag_counts, "customer", "pages", "events", "messy_contacts"), f"WITH {values_sql('customer', 'pages', 'events', 'messy_contacts')} SELECT src, col, tag, {big('sum(n)')} AS n FROM vals GROUP BY ALL")
add("p02_null_blank_placeholder", per_source(lambda v: p.null_facts(v).drop("pos"), "messy_organizations"), f"""WITH {values_sql("messy_organizations")}
SELECT src, col, {big("sum(n)")} AS n_rows, {n_if("tag NOT IN ('blank', 'placeholder')")} AS non_null, {n_if("tag = 'blank'")} AS blank, {n_if("tag = 'placeholder'")} AS placeholder,
{n_if("tag NOT IN ('blank', 'placeholder') AND (raw <> v OR contains(raw, '  '))")} AS whitespace, {big("coalesce(max(length(v)) FILTER (WHERE tag NOT IN ('blank', 'placeholder')), 0)")} AS max_length FROM vals GROUP BY src, col""")
add("p03_distinct_unique", per_source(p.distinct_facts, "customer", "messy_organizations"), f"WITH {values_sql('customer', 'messy_organizations')} SELECT src, col, {big('count(*)')} AS distinct_count, round_even(100.0 * count(*) / CAST(sum(n) AS DOUBLE), 1) AS unique_pct FROM said GROUP BY src, col")
_RANK = "CAST(row_number() OVER (PARTITION BY src, col ORDER BY n DESC, first) AS INTEGER)"
add("p04_top_values", per_source(p.top_values, "orders", "customer"), f"WITH {values_sql('orders', 'customer')} SELECT * FROM (SELECT src, col, {_RANK} AS rank, v, n FROM said) WHERE rank <= 10")
add("p05_value_counts", per_source(p.value_counts, "customer", "part"), f"WITH {values_sql('customer', 'part')} SELECT src, col, v, n FROM said WHERE (src, col) IN (SELECT (src, col) FROM said GROUP BY src, col HAVING count(*) <= 50)")
_CUT = "CASE WHEN length({0}) > 60 THEN substr({0}, 1, 59) || '…' ELSE {0} END"
add("p06_first_distinct", per_source(p.first_distinct, "part", "events"), f"WITH {values_sql('part', 'events')} SELECT src, col, rank, {_CUT.format('v')} AS v FROM (SELECT *, CAST(row_number() OVER (PARTITION BY src, col ORDER BY first) AS INTEGER) AS rank FROM said) WHERE rank <= 5")
_SHAPE = r"regexp_replace(regexp_replace(regexp_replace(substr(v, 1, 24), '\p{Lu}', 'A', 'g'), '[\p{Ll}\p{Lt}\p{Lm}\p{Lo}]', 'a', 'g'), '\p{Nd}', '9', 'g') || CASE WHEN length(v) > 24 THEN '…' ELSE '' END"
add("p07_shapes", per_source(p.shapes, "customer", "pages", "messy_contacts"), f"""WITH {values_sql("customer", "pages", "messy_contacts")},
g AS (SELECT src, col, {_SHAPE} AS shape, {big("sum(n)")} AS n, min(first) AS first, arg_min(v, first) AS example FROM said GROUP BY ALL)
SELECT src, col, rank, shape, n, {_CUT.format("example")} AS example FROM (SELECT *, {_RANK} AS rank FROM g) WHERE rank <= 5""")
add("p08_case_variants", per_source(p.case_variants, "messy_organizations"), f"WITH {values_sql('messy_organizations')} SELECT src, col, lower(v) AS folded, {big('count(*)')} AS n_spellings, string_agg(v, ' / ' ORDER BY v) AS spellings FROM said GROUP BY src, col, lower(v) HAVING count(*) > 1")
_NUMERIC = ["monthly_amount", "seat_count", "acct_num"]
add("p09_number_stats", per_source(p.number_stats, "messy_subscriptions", columns=_NUMERIC), f"""WITH {values_sql("messy_subscriptions")},
x AS (SELECT *, CASE WHEN tag IN ('integer', 'decimal', 'numeric_text') THEN {sql_number()} END AS number FROM said WHERE {only(_NUMERIC)})
SELECT src, col, min(number) AS min, max(number) AS max, round_even(sum(number * n) / CAST(sum(n) FILTER (WHERE number IS NOT NULL) AS DOUBLE), 2) AS mean, {n_if("number IS NOT NULL")} AS parsed, {n_if("number IS NULL")} AS malformed,
{n_if("tag = 'numeric_text'")} AS numeric_text, {n_if("tag = 'decimal'")} AS decimals, {n_if("number <> floor(number)")} AS fractional FROM x GROUP BY src, col""")
_DATED = ["start_dt", "renew_dt"]
_DATES = f"""d AS (SELECT *, {sql_first("v", cells.DATETIME_FORMATS)} AS t, {sql_first("v", cells.DATETIME_FORMATS, True)} AS tf, {sql_first("v", cells.DATE_FORMATS)} AS dt, {sql_first("v", cells.DATE_FORMATS, True)} AS df FROM said),
dates AS (SELECT *, CASE WHEN t IS NOT NULL AND (contains(v, ':') OR dt IS NULL) THEN t ELSE dt END AS moment, CASE WHEN t IS NOT NULL AND (contains(v, ':') OR dt IS NULL) THEN tf ELSE df END AS fmt FROM d)"""
_ISO = "fmt IN ({})"
add("p10_date_stats", lambda spark, d: p.date_stats(values(spark, d, "messy_subscriptions").drop("src").where(F.col("col").isin(_DATED)), AS_OF).drop("min_at", "max_at").unionByName(p.date_stats(values(spark, d, "messy_organizations").drop("src").where("col = 'created_on'"), AS_OF).drop("min_at", "max_at")),
    f"""WITH {values_sql("messy_subscriptions", "messy_organizations")}, {_DATES}
SELECT col, {n_if("fmt IS NOT NULL")} AS parsed, {n_if("fmt IS NULL")} AS malformed, {big("count(DISTINCT fmt)")} AS n_formats, {n_if(_ISO.format(quoted(cells.ISO_DATE)))} AS iso_dates, {n_if(_ISO.format(quoted(cells.ISO_DATETIME)))} AS iso_datetimes,
{n_if(f"CAST(moment AS DATE) > DATE '{AS_OF}'")} AS future FROM dates WHERE {only([*_DATED, "created_on"])} GROUP BY col""")  # fmt: skip
add("p10b_date_formats", lambda spark, d: p.date_formats(values(spark, d, "messy_organizations").drop("src").where("col = 'created_on'")).unionByName(p.date_formats(values(spark, d, "messy_activity").drop("src").where("col = 'occurred_at'"))),
    f"WITH {values_sql('messy_organizations', 'messy_activity')}, {_DATES} SELECT col, fmt, {big('sum(n)')} AS n FROM dates WHERE {only(['created_on', 'occurred_at'])} AND fmt IS NOT NULL GROUP BY col, fmt")
add("p11_email_stats", per_source(p.email_stats, "messy_contacts", "messy_organizations"), f"WITH {values_sql('messy_contacts', 'messy_organizations')} SELECT src, col, {n_if("tag <> 'email'")} AS malformed, {n_if("tag = 'email' AND v <> lower(v)")} AS uppercase FROM said GROUP BY src, col")
_DIG = rf"CASE WHEN {sql_re('v', cells.PHONE)} AND length(regexp_replace(v, '\D', '', 'g')) BETWEEN 7 AND 15 THEN length(regexp_replace(v, '\D', '', 'g')) END"
add("p12_phone_stats", per_source(p.phone_stats, "messy_contacts"), f"WITH {values_sql('messy_contacts')}, x AS (SELECT *, {_DIG} AS k FROM said) SELECT src, col, {n_if('k IS NULL OR k < 10')} AS malformed, {n_if(r"k >= 10 AND regexp_matches(v, '^\+\d+$')")} AS e164 FROM x GROUP BY src, col")
add("p13_url_stats", per_source(p.url_stats, "messy_organizations", "pages"), f"WITH {values_sql('messy_organizations', 'pages')} SELECT src, col, {n_if("tag = 'url_no_scheme'")} AS no_scheme, {n_if("tag NOT IN ('url', 'url_no_scheme')")} AS malformed FROM said GROUP BY src, col")
add("p14_boolean_stats", per_source(p.boolean_stats, "messy_contacts"), f"""WITH {values_sql("messy_contacts")},
x AS (SELECT *, CASE WHEN lower(v) IN ({quoted(cells.TRUE_WORDS)}) THEN 'true' WHEN lower(v) IN ({quoted(cells.FALSE_WORDS)}) THEN 'false' END AS truth FROM said),
y AS (SELECT *, truth IS NOT NULL AND row_number() OVER (PARTITION BY src, col, truth ORDER BY n DESC, first) = 1 AS canon FROM x)
SELECT src, col, {big("count(*)")} AS spellings, {n_if("NOT canon")} AS variants, {n_if("truth IS NULL")} AS not_boolean FROM y GROUP BY src, col""")
_NORM = r"trim(regexp_replace(lower(v), '\s+', ' ', 'g'), ' .,;')"
add("p15_normalized_duplicates", per_source(p.normalized_duplicates, "messy_organizations", "messy_contacts"), f"WITH {values_sql('messy_organizations', 'messy_contacts')} SELECT src, col, {big(f'sum(n) - count(DISTINCT {_NORM})')} AS duplicates FROM said GROUP BY src, col")
add("p16_exact_duplicates", lambda spark, d: p.exact_duplicates(view(spark, d, "documents"), "doc_id"), "SELECT CAST(sum(c) AS BIGINT) AS n_rows, CAST(sum(c - 1) AS BIGINT) AS duplicate_rows FROM (SELECT count(*) AS c FROM documents GROUP BY text, lang, source, n_chars)")
add("p17b_key_counts", lambda spark, d: view(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("c")).agg(F.sum("c").alias("n_rows"), F.count("*").alias("n_keys"), F.sum(F.col("c") - 1).alias("duplicates")),
    "SELECT CAST(sum(c) AS BIGINT) AS n_rows, count(*) AS n_keys, CAST(sum(c - 1) AS BIGINT) AS duplicates FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey, l_linenumber)")


def types_sql(*sources: str) -> str:
    """values_sql and types(src, col, pos, inferred_type)."""
    s = lambda *tags: f"(coalesce(sum(n) FILTER (WHERE tag IN ({quoted(tags)})), 0) / CAST(sum(n) AS DOUBLE))"
    hint = lambda pattern: sql_re("col", pattern)
    return f"""{values_sql(*sources)}, num AS (SELECT *, {sql_number()} AS number FROM said),
facts AS (SELECT src, col, CASE
  WHEN bool_and(lower(v) IN ({quoted(cells.TRUE_WORDS + cells.FALSE_WORDS)})) AND (NOT bool_and(v IN ('0', '1')) OR {hint(cells.BOOLEAN_HINT)}) THEN 'boolean'
  WHEN {hint(cells.PHONE_HINT)} AND {s("phone", "phone_short", "integer")} >= 0.6 THEN 'phone'
  WHEN {s("identifier")} >= 0.6 THEN 'identifier'
  WHEN {s("integer", "decimal", "numeric_text")} >= 0.6 THEN CASE WHEN {s("decimal", "numeric_text")} = 0 THEN CASE WHEN {hint(cells.KEY_HINT)} THEN 'identifier' ELSE 'integer' END
       WHEN NOT coalesce(bool_or(number <> floor(number)), false) THEN 'integer' ELSE 'decimal' END
  WHEN {s("date", "datetime")} >= 0.6 THEN CASE WHEN {s("datetime")} >= {s("date")} THEN 'datetime' ELSE 'date' END
  WHEN {s("email", "email_malformed")} >= 0.6 THEN 'email' WHEN {s("url", "url_no_scheme")} >= 0.6 THEN 'url' WHEN {s("phone", "phone_short")} >= 0.6 THEN 'phone' WHEN {s("code")} >= 0.6 THEN 'code'
  WHEN count(*) <= 25 AND sum(n) >= 20 AND count(*) / CAST(sum(n) AS DOUBLE) <= 0.1 THEN 'category' ELSE 'text' END AS kind FROM num GROUP BY src, col),
types AS (SELECT DISTINCT vals.src, vals.col, vals.pos, coalesce(kind, 'empty') AS inferred_type FROM vals LEFT JOIN facts USING (src, col))"""


add("p18_type_decision", per_source(p.column_types, "customer", "orders", "pages", "messy_organizations", "messy_contacts", "messy_subscriptions", "messy_activity", written=False), f"WITH {types_sql('customer', 'orders', 'pages', 'messy_organizations', 'messy_contacts', 'messy_subscriptions', 'messy_activity')} SELECT src, col, pos, inferred_type FROM types")


_KEYED = ["messy_organizations", "messy_contacts", "messy_subscriptions", "messy_activity"]
add("p17_key_facts", per_source(p.key_facts, *_KEYED, written=False), f"""WITH {types_sql(*_KEYED)},
a AS (SELECT src, col, sum(n) AS n_rows, coalesce(sum(n) FILTER (WHERE tag NOT IN ('blank', 'placeholder')), 0) AS filled FROM vals GROUP BY src, col),
f AS (SELECT src, col, pos, inferred_type, n_rows, filled, coalesce(d, 0) AS d, CASE WHEN coalesce(d, 0) = 0 THEN 0.0 ELSE round_even(100.0 * d / CAST(filled AS DOUBLE), 1) END AS u FROM types JOIN a USING (src, col) LEFT JOIN (SELECT src, col, count(*) AS d FROM said GROUP BY src, col) USING (src, col)),
g AS (SELECT *, {sql_re("col", cells.KEY_HINT)} AND inferred_type IN ('identifier', 'integer', 'code', 'text') AND u >= 90 AND round_even(100.0 * (n_rows - filled) / CAST(n_rows AS DOUBLE), 1) <= 20 AS fits FROM f)
SELECT src, col, {big("n_rows - filled")} AS missing, {big("filled - d")} AS duplicates, fits AND row_number() OVER (PARTITION BY src ORDER BY fits DESC, u DESC, pos) = 1 AS is_key FROM g""")


def _references(spark: SparkSession, d: str) -> DataFrame:
    """Of all four tables at once; what refers to what is told by the names of their columns."""
    named = lambda table, row, key, name: view(spark, d, table).select(F.col(row).alias("row_idx"), F.col(key).alias(name))
    frames = {"orders": named("orders", "o_orderkey", "o_custkey", "customer"), "customer": named("customer", "c_custkey", "c_custkey", "customer")}
    frames |= {"events": named("events", "event_id", "user_id", "supplier"), "supplier": named("supplier", "s_suppkey", "s_suppkey", "supplier")}
    return p.references(frames, {"customer": "customer", "supplier": "supplier"}).drop("column", "references")


def _reference_sql(child: str, row: str, key: str, parent: str, parent_key: str) -> str:
    return f"""SELECT '{child}' AS child, count(*) AS checked, count(*) FILTER (WHERE held) AS resolved, count(*) FILTER (WHERE NOT held) AS orphans,
round_even(100.0 * count(*) FILTER (WHERE NOT held) / count(*), 1) AS orphan_pct,
(SELECT coalesce(string_agg(v, ', ' ORDER BY f), '') FROM (SELECT CAST({key} AS VARCHAR) AS v, min({row}) AS f FROM {child} WHERE {key} NOT IN (SELECT {parent_key} FROM {parent}) GROUP BY {key} ORDER BY f LIMIT 5)) AS examples
FROM (SELECT {key} IN (SELECT {parent_key} FROM {parent}) AS held FROM {child} WHERE {key} IS NOT NULL)"""


add("p19_references", _references, _reference_sql("orders", "o_orderkey", "o_custkey", "customer", "c_custkey") + " UNION ALL " + _reference_sql("events", "event_id", "user_id", "supplier", "s_suppkey"))


def _issues(spark: SparkSession, d: str) -> DataFrame:
    columns = SOURCES["messy_organizations"][1]
    return p.quality_issues(view(spark, d, "messy_organizations").select("row_idx", *columns), AS_OF)


add("p20_quality_issues", _issues, f"""WITH {types_sql("messy_organizations")}, {_DATES},
facts2 AS (SELECT col, CAST(sum(n) AS BIGINT) AS n_rows, {n_if("tag NOT IN ('blank', 'placeholder')")} AS non_null, {n_if("tag IN ('blank', 'placeholder')")} AS nulls, {n_if("tag = 'placeholder'")} AS placeholder,
  {n_if("tag NOT IN ('blank', 'placeholder') AND (raw <> v OR contains(raw, '  '))")} AS ws FROM vals GROUP BY col),
s AS (SELECT col, CAST(sum(n) AS BIGINT) AS filled, count(*) AS d, {n_if("tag NOT IN ('integer', 'decimal', 'numeric_text') OR number IS NULL")} AS bad_number, {n_if("tag = 'numeric_text'")} AS numeric_text, {n_if("tag = 'decimal'")} AS dec,
  {n_if("tag <> 'email'")} AS bad_email, {n_if("tag = 'email' AND v <> lower(v)")} AS upper_email, {n_if("tag = 'url_no_scheme'")} AS no_scheme, {n_if("tag NOT IN ('url', 'url_no_scheme')")} AS bad_url,
  {n_if("tag NOT IN ('identifier', 'integer', 'code')")} AS bad_id, CAST(sum(n) - count(DISTINCT {_NORM}) AS BIGINT) AS dup FROM num GROUP BY col),
dd AS (SELECT col, {n_if("fmt IS NOT NULL")} AS parsed, {n_if("fmt IS NULL")} AS bad_date, count(DISTINCT fmt) AS n_formats, {n_if(_ISO.format(quoted(cells.ISO_DATE)))} AS iso_d, {n_if(f"CAST(moment AS DATE) > DATE '{AS_OF}'")} AS future FROM dates GROUP BY col),
cv AS (SELECT col, count(*) AS groups FROM (SELECT col, lower(v) FROM said GROUP BY col, lower(v) HAVING count(*) > 1) GROUP BY col),
f AS (SELECT * FROM types JOIN facts2 USING (col) LEFT JOIN s USING (col) LEFT JOIN dd USING (col) LEFT JOIN cv USING (col)),
k AS (SELECT col FROM f WHERE {sql_re("col", cells.KEY_HINT)} AND inferred_type IN ('identifier', 'integer', 'code', 'text') AND round_even(100.0 * d / CAST(filled AS DOUBLE), 1) >= 90 AND round_even(100.0 * nulls / CAST(n_rows AS DOUBLE), 1) <= 20 ORDER BY 1.0 * d / CAST(filled AS DOUBLE) DESC, pos LIMIT 1),
i AS (SELECT col AS "column", 'key_missing' AS code, 'error' AS severity, nulls AS count FROM f WHERE col IN (SELECT col FROM k)
UNION ALL SELECT col, 'key_duplicates', 'error', non_null - d FROM f WHERE col IN (SELECT col FROM k)
UNION ALL SELECT col, 'empty_column', 'info', n_rows FROM f WHERE inferred_type = 'empty'
UNION ALL SELECT col, 'null_rate_high', 'warning', nulls FROM f WHERE inferred_type <> 'empty' AND round_even(100.0 * nulls / CAST(n_rows AS DOUBLE), 1) >= 20
UNION ALL SELECT col, 'placeholder_values', 'warning', placeholder FROM f WHERE inferred_type <> 'empty'
UNION ALL SELECT col, 'malformed_' || inferred_type, CASE WHEN inferred_type IN ('email', 'identifier') THEN 'error' ELSE 'warning' END,
   CASE WHEN inferred_type IN ('integer', 'decimal') THEN bad_number WHEN inferred_type IN ('date', 'datetime') THEN bad_date WHEN inferred_type = 'email' THEN bad_email WHEN inferred_type = 'url' THEN bad_url WHEN inferred_type = 'identifier' THEN bad_id END FROM f
UNION ALL SELECT col, 'mixed_date_formats', 'warning', parsed - iso_d FROM f WHERE inferred_type = 'date' AND n_formats > 1
UNION ALL SELECT col, 'future_dates', 'warning', future FROM f WHERE inferred_type IN ('date', 'datetime')
UNION ALL SELECT col, 'numeric_text', 'warning', numeric_text FROM f WHERE inferred_type IN ('integer', 'decimal')
UNION ALL SELECT col, 'float_text', 'info', dec FROM f WHERE inferred_type = 'integer'
UNION ALL SELECT col, 'uppercase_emails', 'info', upper_email FROM f WHERE inferred_type = 'email'
UNION ALL SELECT col, 'url_no_scheme', 'info', no_scheme FROM f WHERE inferred_type = 'url'
UNION ALL SELECT col, 'case_variants', 'info', groups FROM f WHERE inferred_type IN ('category', 'code', 'text', 'email')
UNION ALL SELECT col, 'whitespace', 'info', ws FROM f WHERE inferred_type <> 'empty'
UNION ALL SELECT col, 'normalized_duplicates', 'warning', dup FROM f WHERE (inferred_type = 'email' OR {sql_re("col", cells.NAME_HINT)}) AND round_even(100.0 * d / CAST(filled AS DOUBLE), 1) >= 50
UNION ALL SELECT NULL, 'no_key_column', 'warning', max(n_rows) FROM f WHERE NOT EXISTS (SELECT 1 FROM k)
UNION ALL SELECT NULL, 'duplicate_rows', 'warning', (SELECT count(*) FROM messy_organizations) - (SELECT count(*) FROM (SELECT DISTINCT {", ".join(SOURCES["messy_organizations"][1])} FROM messy_organizations)))
SELECT "column", code, severity, CAST(count AS BIGINT) AS count FROM i WHERE count > 0""")
add("p21_profile_table", per_source(p.profile_table, "customer", "messy_organizations"), f"""WITH {types_sql("customer", "messy_organizations")},
a AS (SELECT src, col, CAST(sum(n) AS BIGINT) AS n_rows, {n_if("tag NOT IN ('blank', 'placeholder')")} AS non_null, {n_if("tag IN ('blank', 'placeholder')")} AS null_count,
  {n_if("tag NOT IN ('blank', 'placeholder') AND (raw <> v OR contains(raw, '  '))")} AS whitespace, {big("coalesce(max(length(v)) FILTER (WHERE tag NOT IN ('blank', 'placeholder')), 0)")} AS max_length FROM vals GROUP BY src, col),
b AS (SELECT src, col, count(*) AS d FROM said GROUP BY src, col)
SELECT src, col, {big("pos")} AS pos, inferred_type, non_null, null_count, CASE WHEN n_rows = 0 THEN 0.0 ELSE round_even(100.0 * null_count / CAST(n_rows AS DOUBLE), 1) END AS null_pct, {big("coalesce(d, 0)")} AS distinct_count,
CASE WHEN coalesce(d, 0) = 0 THEN 0.0 ELSE round_even(100.0 * d / CAST(non_null AS DOUBLE), 1) END AS unique_pct, whitespace, max_length FROM types JOIN a USING (src, col) LEFT JOIN b USING (src, col)""")

_BAD = r"""CASE WHEN inferred_type IN ('integer', 'decimal') THEN tag NOT IN ('integer', 'decimal', 'numeric_text') OR number IS NULL WHEN inferred_type IN ('date', 'datetime') THEN fmt IS NULL
WHEN inferred_type = 'email' THEN tag <> 'email' WHEN inferred_type = 'url' THEN tag NOT IN ('url', 'url_no_scheme') WHEN inferred_type = 'phone' THEN k IS NULL OR k < 10 WHEN inferred_type = 'identifier' THEN tag NOT IN ('identifier', 'integer', 'code') END"""
add("p22_malformed_examples", per_source(p.malformed_examples, "messy_organizations", "messy_contacts"), f"""WITH {types_sql("messy_organizations", "messy_contacts")}, {_DATES},
x AS (SELECT num.src, num.col, num.v, num.first, num.tag, num.number, dates.fmt, {_DIG.replace("v", "num.v")} AS k, inferred_type FROM num JOIN dates USING (src, col, v) JOIN types ON types.src = num.src AND types.col = num.col)
SELECT src, col, rank, {_CUT.format("v")} AS v FROM (SELECT *, CAST(row_number() OVER (PARTITION BY src, col ORDER BY first) AS INTEGER) AS rank FROM x WHERE {_BAD}) WHERE rank <= 5""")
_RECORD = """CASE o_orderkey % 4 WHEN 0 THEN '{"a": 1, "b": "x", "c": true}' WHEN 1 THEN '{"a": "1", "b": null}' WHEN 2 THEN '{"a": 2.5, "c": [1, 2]}' ELSE '{"a": null, "d": {"e": 1}}' END"""


def _json_records(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "orders").select(F.expr(_RECORD).alias("record"))


_JSON_N = lambda *rest: f"count(*) FILTER (WHERE o_orderkey % 4 IN ({', '.join(map(str, rest))}))"
_JSON_SQL = "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS col, '{t}' AS raw_type, {_JSON_N(r)} AS n FROM orders" for c, t, r in (("a", "integer", 0), ("a", "text", 1), ("a", "decimal", 2), ("b", "text", 0), ("c", "boolean", 0), ("c", "list", 2), ("d", "object", 3))) + ") WHERE n > 0"
add("p23_json_types", lambda spark, d: p.json_types(_json_records(spark, d)), _JSON_SQL)


def _typed(spark: SparkSession, d: str) -> DataFrame:
    types = p.json_types(_json_records(spark, d))
    return p.type_issues(types, types.groupBy("col").agg(F.sum("n").alias("non_null")))


add("p24_mixed_json_types", _typed, f"""SELECT col AS "column", 'mixed_json_types' AS code, 'warning' AS severity, CAST(sum(n) - max(n) AS BIGINT) AS count FROM ({_JSON_SQL}) GROUP BY col HAVING count(*) > 1""")
add("p25_orphan_references", lambda spark, d: p.reference_issues(_references(spark, d).select(F.col("child").alias("column"), "orphans")),
    f"""SELECT child AS "column", 'orphan_references' AS code, 'error' AS severity, orphans AS count FROM ({SQL["p19_references"]}) WHERE orphans > 0""")
