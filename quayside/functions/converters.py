"""Converters of cells to target values, as column builders.

A converter takes a text column and gives a Result of four columns. A null in gives nulls out, so a chain needs no
branches: what is empty or failed stays empty, and notes and the first error are gathered along the way.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.functions import cells

# Fixed values.
TITLES = ["mr", "mrs", "ms", "miss", "dr", "prof", "sir", "rev"]
SUFFIXES = ["jr", "sr", "ii", "iii", "iv", "md", "phd", "dds", "dvm", "esq", "cpa", "rn"]
CURRENCY_WORDS = r"(?i)\b(usd|cad|eur|gbp|dollars?)\b"
IDENTIFIER = r"^[A-Za-z0-9][A-Za-z0-9_.-]*$"
ADDRESS = r"^[^@\s]+@[^@\s]+\.[A-Za-z]{2,}$"


class Result(NamedTuple):
    value: Column
    note: Column
    error_type: Column
    error: Column


@dataclass(frozen=True)
class Context:
    """What a converter may know: the target, its closed list, the map of words and what happens to others."""

    target: str = ""
    enum: tuple[str, ...] = ()
    words: dict[str, str] | None = None
    rule: int | None = None
    unmapped: str = "error"  # error, default or null
    date_formats: tuple[str, ...] = ()
    datetime_formats: tuple[str, ...] = ()
    placeholders: tuple[str, ...] = ()
    params: dict = field(default_factory=dict)
    #: The text comes from `trim`: single blanks, none at its ends, so that no pattern has to look for them again.
    trimmed: bool = False


Converter = Callable[[Column, Context], Result]
REGISTRY: dict[str, Converter] = {}


def _none() -> Column:
    return F.lit(None).cast("string")



def converter(name: str) -> Callable[[Converter], Converter]:
    """Registers a converter; users add their own in the same way."""

    def register(fn: Converter) -> Converter:
        REGISTRY[name] = fn
        return fn

    return register


def _result(value: Column, note: Column | None = None, error_type: Column | None = None, error: Column | None = None) -> Result:
    return Result(value, *(_none() if c is None else c for c in (note, error_type, error)))


def _stripped(v: Column, ctx: Context) -> Column:
    return v if ctx.trimmed else cells.strip(v)


def _filled(v: Column, ctx: Context) -> Column:
    """Stripped; null where nothing is left."""
    s = _stripped(v, ctx)
    return F.when(s != "", s)


def _quoted(v: Column) -> Column:
    return F.concat(F.lit("'"), v, F.lit("'"))


def _collapsed(v: Column) -> Column:
    """Each run of white space one blank, none at the ends."""
    return F.trim(F.regexp_replace(v, r"(?U)\s+", " "))


def lookup_key(v: Column, ctx: Context = Context()) -> Column:
    return F.lower(v if ctx.trimmed else _collapsed(v))


def _mapped(key: Column, words: dict[str, str] | None) -> Column:
    if not words:
        return _none()
    return F.element_at(F.create_map(*[F.lit(x) for kv in words.items() for x in kv]), key)


@converter("trim")
def trim(v: Column, ctx: Context) -> Result:
    clean = _collapsed(v)
    return _result(clean, F.when(clean != v, "whitespace normalized"))


@converter("blank_to_null")
def blank_to_null(v: Column, ctx: Context) -> Result:
    key = lookup_key(v, ctx)
    gone = key.isin("", *ctx.placeholders)
    return _result(F.when(~gone, v), F.when(gone & (key != ""), F.concat(F.lit("placeholder "), _quoted(_stripped(v, ctx)), F.lit(" read as empty"))))


@converter("string")
def string(v: Column, ctx: Context) -> Result:
    return _result(_filled(v, ctx))


@converter("identifier")
def identifier(v: Column, ctx: Context) -> Result:
    s = _filled(v, ctx)
    ok = s.rlike(IDENTIFIER)
    return _result(F.when(ok, s), None, F.when(~ok, "invalid_identifier"), F.when(~ok, F.concat(_quoted(s), F.lit(" is not an identifier"))))


def _flat(v: Column) -> Column:
    """All letters in one case."""
    return ((v == F.upper(v)) | (v == F.lower(v))) & v.rlike(r"\p{L}")


def _capital(v: Column) -> Column:
    return F.concat(F.upper(F.substring(v, 1, 1)), F.lower(v.substr(F.lit(2), F.length(v))))


def titled(v: Column) -> Column:
    """A capital for each word and each part at - or '; words in mixed case stay."""
    parts = lambda w, sep, fn: F.array_join(F.transform(F.split(w, sep), fn), sep)
    return F.array_join(F.transform(F.split(v, " "), lambda w: F.when(_flat(w), parts(w, "-", lambda p: parts(p, "'", _capital))).otherwise(w)), " ")


@converter("title_case")
def title_case(v: Column, ctx: Context) -> Result:
    s = _filled(v, ctx)
    return _result(F.when(_flat(s), titled(s)).otherwise(s), F.when(_flat(s), "case normalized"))


def _numeric(v: Column) -> Column:
    """Without currency words and signs. Only a text with letters is looked through for words."""
    bare = F.when(v.rlike("[A-Za-z]"), F.regexp_replace(v, CURRENCY_WORDS, "")).otherwise(v)
    return cells.strip(F.translate(bare, "\u00a0$,", " "))


@converter("money")
def money(v: Column, ctx: Context) -> Result:
    """Symbols, separators and currency words off, M and K read, two places, ties to even."""
    s = _filled(v, ctx)
    bare = _numeric(s)
    lettered = F.upper(F.substring(bare, -1, 1)).isin("M", "K")
    suffix = F.when(lettered, F.upper(F.regexp_extract(bare, r"(?i)^-?[\d,.]+\s*([mk])$", 1)))
    digits = F.when(lettered, F.regexp_replace(bare, r"(?i)(?<=[\d,.])\s*[mk]$", "")).otherwise(bare)
    factor = F.when(suffix == "M", 1000000).when(suffix == "K", 1000).otherwise(1)
    amount = F.bround(digits.try_cast("decimal(28,10)") * factor, 2).cast("decimal(38,2)")
    bad, below = s.isNotNull() & amount.isNull(), amount < 0
    note = F.when(suffix == "M", "M suffix read as millions").when(suffix == "K", "K suffix read as thousands")
    return _result(
        F.when(amount >= 0, amount.cast("string")), F.when(amount >= 0, note), F.when(bad, "unparseable_number").when(below, "out_of_range"),
        F.when(bad, F.concat(_quoted(s), F.lit(" is not an amount"))).when(below, F.concat(_quoted(s), F.lit(" is negative"))),
    )


@converter("integer")
def integer(v: Column, ctx: Context) -> Result:
    s = _filled(v, ctx)
    number = _numeric(s).try_cast("decimal(28,10)")
    bad = s.isNotNull() & number.isNull()
    part, below = number != F.floor(number), number < 0
    whole = F.floor(number).cast("decimal(28,0)").cast("string")
    fine = ~part & ~below
    return _result(
        F.when(fine, whole), F.when(fine & (s != whole), "stored as text in the source"), F.when(bad | part, "unparseable_number").when(below, "out_of_range"),
        F.when(bad, F.concat(_quoted(s), F.lit(" is not a number"))).when(part, F.concat(_quoted(s), F.lit(" is not a whole number"))).when(below, F.concat(_quoted(s), F.lit(" is negative"))),
    )


@converter("boolean")
def boolean(v: Column, ctx: Context) -> Result:
    s = _filled(v, ctx)
    key = lookup_key(s, ctx)
    value = F.when(key.isin(cells.TRUE_WORDS), "true").when(key.isin(cells.FALSE_WORDS), "false")
    bad = s.isNotNull() & value.isNull()
    return _result(value, None, F.when(bad, "unparseable_boolean"), F.when(bad, F.concat(_quoted(s), F.lit(" is not a yes or a no"))))


@converter("date")
def date(v: Column, ctx: Context) -> Result:
    s = _filled(v, ctx)
    at, fmt = cells.first_format(s, list(ctx.date_formats))
    bad = s.isNotNull() & at.isNull()
    return _result(F.date_format(at, "yyyy-MM-dd"), F.when(fmt != "%Y-%m-%d", F.concat(F.lit("date read as "), fmt)), F.when(bad, "unparseable_date"), F.when(bad, F.concat(_quoted(s), F.lit(" matches no date format"))))


@converter("datetime")
def datetime(v: Column, ctx: Context) -> Result:
    """To UTC; a time without a zone is read as UTC and says so."""
    s = _filled(v, ctx)
    text = F.replace(s, F.lit("Z"), F.lit("+0000"))
    at, fmt = cells.first_format(text, list(ctx.datetime_formats))
    zoned = fmt.endswith("%z")
    utc = F.when(zoned, at - F.make_dt_interval(F.lit(0), F.lit(0), cells.zone_offset_minutes(text))).otherwise(at)
    bad = s.isNotNull() & at.isNull()
    note = F.when(~zoned, F.concat(F.lit("timestamp read as "), fmt, F.lit(", no timezone in the source, assumed UTC"))).when(~fmt.startswith("%Y-%m-%dT"), F.concat(F.lit("timestamp read as "), fmt))
    return _result(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss'Z'"), note, F.when(bad, "unparseable_datetime"), F.when(bad, F.concat(_quoted(s), F.lit(" matches no timestamp format"))))


@converter("email")
def email(v: Column, ctx: Context) -> Result:
    s = _filled(v, ctx)
    low = F.lower(s)
    ok = low.rlike(ADDRESS)
    return _result(F.when(ok, low), F.when(low != s, "lowercased"), F.when(~ok, "malformed_email"), F.when(~ok, F.concat(_quoted(s), F.lit(" is not an email address"))))


@converter("phone_e164")
def phone_e164(v: Column, ctx: Context) -> Result:
    s = _filled(v, ctx)
    digits = F.regexp_replace(s, r"\D", "")
    n = F.length(digits)
    plus = s.startswith("+") & n.between(7, 15)
    full = (n == 11) & digits.startswith("1")
    value = F.when(plus | full, F.concat(F.lit("+"), digits)).when(n == 10, F.concat(F.lit("+1"), digits))
    bad = s.isNotNull() & value.isNull()
    kind = F.when(bad, F.when((n > 0) & (n < 10), "phone_too_short").otherwise("unparseable_phone"))
    return _result(value, F.when(~plus & (n == 10), "assumed +1 country code"), kind, F.when(bad, F.concat(_quoted(s), F.lit(" has "), n.cast("string"), F.lit(" digits"))))


@converter("url")
def url(v: Column, ctx: Context) -> Result:
    s = _filled(v, ctx)
    schemed = s.rlike(r"(?i)^https?://")
    bad = ~schemed & (~s.contains(".") | s.contains(" "))
    return _result(F.when(schemed, s).when(~bad, F.concat(F.lit("https://"), s)), F.when(~schemed & ~bad, "https:// added"), F.when(bad, "unparseable_url"), F.when(bad, F.concat(_quoted(s), F.lit(" is not a website"))))


def _found_once(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn of a value that is computed once, however often fn looks at it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def _name_words(v: Column) -> Column:
    words = F.transform(F.split(v, " "), lambda w: F.btrim(cells.strip(w), F.lit(".,")))
    return F.filter(words, lambda w: (w != "") & ~F.lower(w).isin(TITLES + SUFFIXES))


def _name_parts(raw: Column) -> Column:
    """(comma, first, last) of a name: its words behind and before the comma, or the first word and the others."""
    comma = F.locate(",", raw)
    behind = F.struct(F.lit(True).alias("comma"), _name_words(raw.substr(comma + 1, F.length(raw))).alias("first"), _name_words(raw.substr(F.lit(1), comma - 1)).alias("last"))
    words = lambda w: F.struct(F.lit(False).alias("comma"), F.slice(w, 1, 1).alias("first"), F.when(F.size(w) > 1, F.slice(w, F.lit(2), F.size(w))).otherwise(F.array().cast("array<string>")).alias("last"))
    return F.when(comma > 0, behind).when(raw.isNotNull(), _found_once(_name_words(raw), words))


@converter("person_name_split")
def person_name_split(v: Column, ctx: Context) -> Result:
    """First and last name with a tab between; names_of() takes them apart."""
    raw = _filled(v if ctx.trimmed else _collapsed(v), dataclasses.replace(ctx, trimmed=True))
    name = lambda p: F.struct(p["comma"].alias("comma"), ((F.size(p["first"]) > 0) & (F.size(p["last"]) > 0)).alias("ok"), *[titled(F.array_join(p[k], " ")).alias(k) for k in ("first", "last")])
    found = _found_once(_name_parts(raw), name)
    ok, a, b = (found[k] for k in ("ok", "first", "last"))
    note = F.nullif(F.concat_ws("; ", F.when(found["comma"], "read as last-first"), F.when(raw != F.concat(a, F.lit(" "), b), "name split in two")), F.lit(""))
    value = F.concat(F.substring(a, 1, 100), F.lit("\t"), F.substring(b, 1, 100))
    return _result(F.when(ok, value), F.when(ok, note), F.when(~ok & raw.isNotNull(), "incomplete_name"), F.when(~ok & raw.isNotNull(), F.concat(_quoted(raw), F.lit(" has no surname"))))


def names_of(v: Column) -> tuple[Column, Column]:
    both = F.split(v, "\t")
    return F.get(both, 0), F.get(both, 1)


@converter("enum_map")
def enum_map(v: Column, ctx: Context) -> Result:
    """The map first, then the closed list itself; what happens to other words is the map's policy."""
    s = _filled(v, ctx)
    if ctx.words is None and not ctx.enum:
        return _result(s)
    key = lookup_key(s, ctx)
    mapped = _mapped(key, ctx.words)
    exact = _mapped(key, {e.lower(): e for e in ctx.enum})
    rule = f" (customer rule {ctx.rule})" if ctx.rule else ""
    said = F.when(key != F.lower(mapped), F.concat(_quoted(s), F.lit(" mapped to "), _quoted(mapped), F.lit(rule)))
    other = s.isNotNull() & mapped.isNull() & exact.isNull()
    policy = ctx.unmapped if ctx.words is not None else "error"
    left = {"default": ", left to the default", "null": ", left empty"}.get(policy)
    note = F.when(mapped.isNotNull(), said).when(exact.isNotNull() & (exact != s), "case normalized")
    if left:
        return _result(F.coalesce(mapped, exact), F.when(other, F.concat(_quoted(s), F.lit(f" is not in the {ctx.target} map{left}"))).otherwise(note))
    return _result(F.coalesce(mapped, exact), note, F.when(other, "unmapped_value"), F.when(other, F.concat(_quoted(s), F.lit(f" is not a known value for {ctx.target}"))))


def _code(v: Column, ctx: Context) -> tuple[Column, Column, Column, Column]:
    s = _filled(v, ctx)
    mapped = _mapped(lookup_key(s, ctx), ctx.words)
    two = F.when(s.rlike(r"^[A-Za-z]{2}$"), F.upper(s))
    other = s.isNotNull() & mapped.isNull() & two.isNull()
    return s, mapped, two, other


@converter("country_code")
def country_code(v: Column, ctx: Context) -> Result:
    s, mapped, two, other = _code(v, ctx)
    note = F.when(mapped.isNotNull(), F.when(mapped != s, F.concat(_quoted(s), F.lit(" mapped to "), _quoted(mapped)))).when(two != s, "uppercased")
    return _result(F.coalesce(mapped, two), note, F.when(other, "unmapped_value"), F.when(other, F.concat(_quoted(s), F.lit(" is not a known country"))))


@converter("region_code")
def region_code(v: Column, ctx: Context) -> Result:
    s, mapped, two, other = _code(v, ctx)
    note = F.when(mapped.isNotNull(), F.concat(_quoted(s), F.lit(" mapped to "), _quoted(mapped))).when(two != s, "uppercased").when(other, F.concat(_quoted(s), F.lit(" is not a known state or province, dropped")))
    return _result(F.coalesce(mapped, two), note)


@converter("string_list")
def string_list(v: Column, ctx: Context) -> Result:
    """Cut at ; , or |, each once whatever its case, of 50 characters, the first ten, joined by |."""
    parts = F.filter(F.transform(F.split(v, r"[;,|]"), cells.strip), lambda p: p != "")
    # Later parts are compared with what was kept of earlier ones, which is cut to 50 characters.
    once = F.aggregate(parts, F.array().cast("array<string>"), lambda kept, p: F.when(F.array_contains(F.transform(kept, F.lower), F.lower(p)), kept).otherwise(F.concat(kept, F.array(F.substring(p, 1, 50)))))
    n = F.size(once)
    return _result(F.when(n > 0, F.array_join(F.slice(once, 1, 10), "|")), F.when(n > 10, F.concat(n.cast("string"), F.lit(" values found, first 10 kept"))))


def _after(name: str, ctx: Context) -> Context:
    """What the next converter may know. A text stays trimmed from `trim` through `blank_to_null`."""
    return dataclasses.replace(ctx, trimmed=name == "trim" or (ctx.trimmed and name == "blank_to_null"))


def apply_chain(v: Column, names: list[str] | tuple[str, ...], ctx: Context) -> Result:
    """Left to right; empty values and errors end it, notes add up."""
    notes, kinds, errors = [], [], []
    for name in names:
        if name not in REGISTRY:
            raise KeyError(f"unknown converter {name!r}")
        step = REGISTRY[name](v, ctx)
        ctx = _after(name, ctx)
        v = step.value
        notes.append(step.note)
        kinds.append(step.error_type)
        errors.append(step.error)
    return Result(v, F.nullif(F.concat_ws("; ", *notes), F.lit("")), F.coalesce(*kinds, _none()), F.coalesce(*errors, _none()))


def stage_chains(df: DataFrame, jobs: dict[str, tuple[str, tuple[str, ...], Context]]) -> DataFrame:
    """Adds a struct (value, note, error_type, error) for each job: name -> (source column, chain, context).

    Every step of all chains is one projection over plain columns of the step before, so that no step's expression is
    copied into the next and generated code stays small.
    """
    df = df.withColumns({f"{n}_v0": F.col(source).cast("string") for n, (source, _, _) in jobs.items()})
    for k in range(max((len(chain) for _, chain, _ in jobs.values()), default=0)):
        step = {}
        for n, (_, chain, ctx) in jobs.items():
            if k < len(chain):
                for before in chain[:k]:
                    ctx = _after(before, ctx)
                r = REGISTRY[chain[k]](F.col(f"{n}_v{k}"), ctx)
                step |= {f"{n}_v{k + 1}": r.value, f"{n}_n{k}": r.note, f"{n}_t{k}": r.error_type, f"{n}_e{k}": r.error}
        df = df.withColumns(step)
    out = {}
    for n, (_, chain, _) in jobs.items():
        each = lambda kind, n=n, chain=chain: [F.col(f"{n}_{kind}{k}") for k in range(len(chain))]
        out[n] = F.struct(F.col(f"{n}_v{len(chain)}").alias("value"), F.nullif(F.concat_ws("; ", *each("n")), F.lit("")).alias("note"), F.coalesce(*each("t")).alias("error_type"), F.coalesce(*each("e")).alias("error"))
    steps = [f"{n}_{kind}{k}" for n, (_, chain, _) in jobs.items() for k in range(len(chain) + 1) for kind in "vnte"]
    return df.withColumns(out).drop(*steps)
