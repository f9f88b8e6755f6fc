"""One query per converter: value, note and error type of every row, and the SQL that states the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.catalogue.profiling import quoted, sql_first, sql_re, sql_strip, sql_time
from quayside.catalogue.views import VIEWS, view
from quayside.functions import cells
from quayside.functions.converters import IDENTIFIER, SUFFIXES, TITLES, apply_chain
from quayside.plans.contract import CONTRACT
from quayside.plans.example_config import EXAMPLE
from quayside.plans.shared import spread

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def add(name: str, source: str, column: str, chain: list[str], target: str, body: str) -> None:
    """body: SQL for value, note and error_type over `x`, which has row_idx, raw and s (stripped, null if empty)."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = spread(view(spark, sf_dir, source))
        r = apply_chain(F.col(column), chain, EXAMPLE.context(target))
        return df.select(F.col("row_idx").cast("long").alias("row_idx"), r.value.alias("value"), r.note.alias("note"), r.error_type.alias("error_type"))

    Q[name] = query
    SQL[name] = f"""WITH {source} AS ({VIEWS[source].strip()}),
x AS (SELECT CAST(row_idx AS BIGINT) AS row_idx, {column} AS raw, nullif({sql_strip(column)}, '') AS s FROM {source})
SELECT row_idx, {body} FROM x"""


NONE = "CAST(NULL AS VARCHAR)"
KEY = rf"lower({sql_strip(r"regexp_replace(s, '\s+', ' ', 'g')")})"


def out(value: str, note: str = NONE, error_type: str = NONE) -> str:
    return f"{value} AS value, {note} AS note, {error_type} AS error_type"


_TRIM = sql_strip(r"regexp_replace(raw, '\s+', ' ', 'g')")
_GONE = f"(s IS NULL OR {KEY} IN ({quoted(EXAMPLE.placeholders)}))"
add("c01_trim", "messy_organizations", "company_name", ["trim"], "organization.name", out(_TRIM, f"CASE WHEN {_TRIM} <> raw THEN 'whitespace normalized' END"))
add("c02_blank_to_null", "messy_organizations", "website", ["blank_to_null"], "organization.website", out(f"CASE WHEN NOT {_GONE} THEN raw END", f"CASE WHEN {_GONE} AND s IS NOT NULL THEN 'placeholder ''' || s || ''' read as empty' END"))
add("c03_string", "messy_organizations", "company_name", ["string"], "organization.name", out("s"))
add("c04_identifier", "messy_organizations", "company_name", ["identifier"], "organization.organization_id", out(f"CASE WHEN {sql_re('s', IDENTIFIER)} THEN s END", NONE, f"CASE WHEN NOT {sql_re('s', IDENTIFIER)} THEN 'invalid_identifier' END"))


def sql_titled(e: str) -> str:
    """Capitals at the start and after -; the fixtures have no apostrophes."""
    return f"array_to_string(list_transform(string_split({e}, ' '), lambda w: CASE WHEN w = upper(w) OR w = lower(w) THEN array_to_string(list_transform(string_split(w, '-'), lambda q: upper(substr(q, 1, 1)) || lower(substr(q, 2))), '-') ELSE w END), ' ')"


_FLAT = "(s = upper(s) OR s = lower(s))"
add("c05_title_case", "messy_contacts", "full_name", ["title_case"], "contact.last_name", out(f"CASE WHEN {_FLAT} THEN {sql_titled('s')} ELSE s END", f"CASE WHEN {_FLAT} THEN 'case normalized' END"))
_BARE = rf"{sql_strip(r"replace(replace(regexp_replace(s, '(?i)\b(usd|cad|eur|gbp|dollars?)\b', '', 'g'), '$', ''), ',', '')")}"
_SUFFIX = rf"upper(regexp_extract({_BARE}, '(?i)^-?[\d.]+\s*([mk])$', 1))"
_AMOUNT = rf"(try_cast(CASE WHEN {_SUFFIX} <> '' THEN regexp_replace({_BARE}, '(?i)\s*[mk]$', '') ELSE {_BARE} END AS DECIMAL(28, 10)) * CASE {_SUFFIX} WHEN 'M' THEN 1000000 WHEN 'K' THEN 1000 ELSE 1 END)"
MONEY = f"CAST(CAST({_AMOUNT} AS DECIMAL(38, 2)) AS VARCHAR)"
_MONEY_OUT = out(f"CASE WHEN {_AMOUNT} >= 0 THEN {MONEY} END", f"CASE WHEN {_AMOUNT} >= 0 THEN CASE {_SUFFIX} WHEN 'M' THEN 'M suffix read as millions' WHEN 'K' THEN 'K suffix read as thousands' END END", f"CASE WHEN s IS NOT NULL AND {_AMOUNT} IS NULL THEN 'unparseable_number' WHEN {_AMOUNT} < 0 THEN 'out_of_range' END")
add("c06_money", "messy_organizations", "annual_revenue", ["money"], "organization.annual_revenue_usd", _MONEY_OUT)
_INT = f"try_cast({_BARE} AS DECIMAL(28, 10))"
_WHOLE = f"CAST(CAST(floor({_INT}) AS DECIMAL(28, 0)) AS VARCHAR)"
_FINE = f"({_INT} = floor({_INT}) AND {_INT} >= 0)"
add("c07_integer", "messy_organizations", "employee_count", ["integer"], "organization.employee_count", out(f"CASE WHEN {_FINE} THEN {_WHOLE} END", f"CASE WHEN {_FINE} AND s <> {_WHOLE} THEN 'stored as text in the source' END", f"CASE WHEN s IS NOT NULL AND ({_INT} IS NULL OR {_INT} <> floor({_INT})) THEN 'unparseable_number' WHEN {_INT} < 0 THEN 'out_of_range' END"))
_BOOL = f"CASE WHEN {KEY} IN ({quoted(cells.TRUE_WORDS)}) THEN 'true' WHEN {KEY} IN ({quoted(cells.FALSE_WORDS)}) THEN 'false' END"
add("c08_boolean", "messy_contacts", "is_primary", ["boolean"], "contact.is_primary", out(_BOOL, NONE, f"CASE WHEN s IS NOT NULL AND {_BOOL} IS NULL THEN 'unparseable_boolean' END"))
_DF = list(EXAMPLE.date_formats)
DATE = f"strftime({sql_first('s', _DF)}, '%Y-%m-%d')"
add("c09_date", "messy_organizations", "created_on", ["date"], "organization.customer_since", out(DATE, f"CASE WHEN {sql_first('s', _DF, True)} <> '%Y-%m-%d' THEN 'date read as ' || {sql_first('s', _DF, True)} END", f"CASE WHEN s IS NOT NULL AND {sql_first('s', _DF)} IS NULL THEN 'unparseable_date' END"))
_Z = "replace(s, 'Z', '+0000')"
_TF = sql_first(_Z, list(EXAMPLE.datetime_formats), True)
_OFF = rf"(CASE WHEN regexp_extract({_Z}, '([+-])\d{{2}}:?\d{{2}}$', 1) = '-' THEN -1 ELSE 1 END * (60 * CAST(coalesce(nullif(regexp_extract({_Z}, '[+-](\d{{2}}):?\d{{2}}$', 1), ''), '0') AS INTEGER) + CAST(coalesce(nullif(regexp_extract({_Z}, '[+-]\d{{2}}:?(\d{{2}})$', 1), ''), '0') AS INTEGER)))"
_ZONED = "coalesce(" + ", ".join(sql_time(_Z, f) for f in EXAMPLE.datetime_formats if f.endswith("%z")) + ")"
_UTC = f"CASE WHEN right({_TF}, 2) = '%z' THEN {_ZONED} - to_minutes({_OFF}) ELSE {sql_first(_Z, list(EXAMPLE.datetime_formats))} END"
add("c10_datetime", "messy_activity", "occurred_at", ["datetime"], "activity.occurred_at", out(f"strftime({_UTC}, '%Y-%m-%dT%H:%M:%SZ')", f"CASE WHEN right({_TF}, 2) <> '%z' THEN 'timestamp read as ' || {_TF} || ', no timezone in the source, assumed UTC' WHEN left({_TF}, 9) <> '%Y-%m-%dT' THEN 'timestamp read as ' || {_TF} END", f"CASE WHEN s IS NOT NULL AND {_TF} IS NULL THEN 'unparseable_datetime' END"))
_MAIL = r"regexp_full_match(lower(s), '[^@\s]+@[^@\s]+\.[A-Za-z]{2,}')"
add("c11_email", "messy_contacts", "contact_mail", ["email"], "contact.email", out(f"CASE WHEN {_MAIL} THEN lower(s) END", "CASE WHEN lower(s) <> s THEN 'lowercased' END", f"CASE WHEN NOT {_MAIL} THEN 'malformed_email' END"))
_D = r"regexp_replace(s, '\D', '', 'g')"
_PHONE = f"CASE WHEN (s LIKE '+%' AND length({_D}) BETWEEN 7 AND 15) OR (length({_D}) = 11 AND {_D} LIKE '1%') THEN '+' || {_D} WHEN length({_D}) = 10 THEN '+1' || {_D} END"
add("c12_phone_e164", "messy_contacts", "phone_number", ["phone_e164"], "contact.phone", out(_PHONE, f"CASE WHEN NOT (s LIKE '+%' AND length({_D}) BETWEEN 7 AND 15) AND length({_D}) = 10 THEN 'assumed +1 country code' END", f"CASE WHEN s IS NOT NULL AND {_PHONE} IS NULL THEN CASE WHEN length({_D}) BETWEEN 1 AND 9 THEN 'phone_too_short' ELSE 'unparseable_phone' END END"))
_SCHEME = "regexp_matches(s, '(?i)^https?://')"
_NO_URL = f"(NOT {_SCHEME} AND (NOT contains(s, '.') OR contains(s, ' ')))"
add("c13_url", "messy_organizations", "website", ["url"], "organization.website", out(f"CASE WHEN {_SCHEME} THEN s WHEN NOT {_NO_URL} THEN 'https://' || s END", f"CASE WHEN NOT {_SCHEME} AND NOT {_NO_URL} THEN 'https:// added' END", f"CASE WHEN {_NO_URL} THEN 'unparseable_url' END"))


def _words_sql(e: str) -> str:
    return f"list_filter(list_transform(string_split({e}, ' '), lambda w: trim(w, '.,')), lambda w: w <> '' AND lower(w) NOT IN ({quoted(TITLES + SUFFIXES)}))"


_RAW = sql_strip(r"regexp_replace(raw, '\s+', ' ', 'g')")
_COMMA = f"contains({_RAW}, ',')"
_FIRST = f"CASE WHEN {_COMMA} THEN {_words_sql(f'substr({_RAW}, strpos({_RAW}, chr(44)) + 1)')} ELSE {_words_sql(_RAW)}[1:1] END"
_LAST = f"CASE WHEN {_COMMA} THEN {_words_sql(f'substr({_RAW}, 1, strpos({_RAW}, chr(44)) - 1)')} ELSE {_words_sql(_RAW)}[2:] END"
_A, _B = (sql_titled(f"array_to_string({e}, ' ')") for e in (_FIRST, _LAST))
_OK = f"(len({_FIRST}) > 0 AND len({_LAST}) > 0)"
add("c14_person_name_split", "messy_contacts", "full_name", ["person_name_split"], "contact.first_name", out(f"CASE WHEN {_OK} THEN {_A} || chr(9) || {_B} END", f"CASE WHEN {_OK} THEN nullif(concat_ws('; ', CASE WHEN {_COMMA} THEN 'read as last-first' END, CASE WHEN {_RAW} <> {_A} || ' ' || {_B} THEN 'name split in two' END), '') END", f"CASE WHEN s IS NOT NULL AND NOT {_OK} THEN 'incomplete_name' END"))


def map_sql(words: dict[str, str], key: str = KEY) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in words.items()) + " END"


def _enum_out(target: str) -> str:
    own, enum = EXAMPLE.value_maps[target], CONTRACT[target].enum
    mapped, exact = map_sql(own.words), map_sql({e: e for e in enum})
    rule = f" || ' (customer rule {own.rule})'" if own.rule else ""
    said = f"CASE WHEN {mapped} IS NOT NULL THEN CASE WHEN {KEY} <> lower({mapped}) THEN '''' || s || ''' mapped to ''' || {mapped} || ''''{rule} END WHEN {exact} IS NOT NULL AND {exact} <> s THEN 'case normalized' END"
    other = f"(s IS NOT NULL AND {mapped} IS NULL AND {exact} IS NULL)"
    if own.unmapped == "error":
        return out(f"coalesce({mapped}, {exact})", said, f"CASE WHEN {other} THEN 'unmapped_value' END")
    left = {"default": "left to the default", "null": "left empty"}[own.unmapped]
    return out(f"coalesce({mapped}, {exact})", f"CASE WHEN {other} THEN '''' || s || ''' is not in the {target} map, {left}' ELSE {said} END")


add("c15_enum_map", "messy_organizations", "company_status", ["enum_map"], "organization.lifecycle_status", _enum_out("organization.lifecycle_status"))
add("c15b_enum_map_default", "messy_contacts", "contact_role", ["enum_map"], "contact.role", _enum_out("contact.role"))


def _code_out(target: str, drop: bool) -> str:
    mapped = map_sql(EXAMPLE.value_maps[target].words)
    two = "CASE WHEN regexp_full_match(s, '[A-Za-z]{2}') THEN upper(s) END"
    other = f"(s IS NOT NULL AND {mapped} IS NULL AND {two} IS NULL)"
    said = f"'''' || s || ''' mapped to ''' || {mapped} || ''''"
    if drop:
        return out(f"coalesce({mapped}, {two})", f"CASE WHEN {mapped} IS NOT NULL THEN {said} WHEN {two} <> s THEN 'uppercased' WHEN {other} THEN '''' || s || ''' is not a known state or province, dropped' END")
    return out(f"coalesce({mapped}, {two})", f"CASE WHEN {mapped} IS NOT NULL THEN CASE WHEN {mapped} <> s THEN {said} END WHEN {two} <> s THEN 'uppercased' END", f"CASE WHEN {other} THEN 'unmapped_value' END")


add("c16_country_code", "messy_organizations", "country", ["country_code"], "organization.billing_country", _code_out("organization.billing_country", False))
add("c17_region_code", "messy_organizations", "hq_state", ["region_code"], "organization.billing_region", _code_out("organization.billing_region", True))
_PARTS = rf"list_filter(list_transform(regexp_split_to_array(raw, '[;,|]'), lambda q: {sql_strip('q')}), lambda q: q <> '')"
add("c18_string_list", "messy_contacts", "full_name", ["string_list"], "organization.tags", out(f"nullif(array_to_string({_PARTS}, '|'), '')"))
_CHAIN = out(f"CASE WHEN NOT {_GONE} AND {_AMOUNT} >= 0 THEN {MONEY} END", f"nullif(concat_ws('; ', CASE WHEN {_TRIM} <> raw THEN 'whitespace normalized' END, CASE WHEN {_GONE} AND s IS NOT NULL THEN 'placeholder ''' || s || ''' read as empty' END, CASE WHEN NOT {_GONE} AND {_AMOUNT} >= 0 THEN CASE {_SUFFIX} WHEN 'M' THEN 'M suffix read as millions' WHEN 'K' THEN 'K suffix read as thousands' END END), '')", f"CASE WHEN NOT {_GONE} THEN CASE WHEN {_AMOUNT} IS NULL THEN 'unparseable_number' WHEN {_AMOUNT} < 0 THEN 'out_of_range' END END")
add("c19_chain", "messy_organizations", "annual_revenue", ["trim", "blank_to_null", "money"], "organization.annual_revenue_usd", _CHAIN)


