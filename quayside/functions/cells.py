"""Classification of single cells as column expressions: null-likeness, tags, numbers, dates, shapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
PLACEHOLDERS = ["n/a", "na", "n.a.", "none", "null", "nil", "unknown", "-", "--", "?", "tbd", "todo", "missing"]
TRUE_WORDS = ["y", "yes", "true", "t", "1"]
FALSE_WORDS = ["n", "no", "false", "f", "0"]

#: White space as Unicode has it.
WHITE = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))

# Patterns of cells and of column names.
INTEGER = r"^[+-]?\d+$"
DECIMAL = r"^[+-]?(\d+\.\d*|\.\d+)$"
NUMERIC_TEXT = r"^(?:[A-Z]{3}\s|[$€£]\s?)?[+-]?\d[\d,]*(?:\.\d+)?\s?(?:[MKkBb]|%)?$"
EMAIL = r"^[A-Za-z0-9._%+'-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}$"
URL = r"(?i)^https?://\S+$"
URL_NO_SCHEME = r"(?i)^(www\.)?[a-z0-9-]+(\.[a-z0-9-]+)*\.[a-z]{2,}(/\S*)?$"
PHONE = r"^\+?[\d\s().-]{7,24}$"
CODE = r"^[A-Z][A-Z0-9]{1,5}$"
IDENTIFIER = r"^[A-Za-z]{1,6}[-_]?\d{3,}$"
PHONE_HINT = r"(?i)(^|_)(phone|tel|telephone|mobile|cell|fax)(_|$)"
KEY_HINT = r"(?i)(^|_)(id|ref|num|no|key|code|number|identifier)(_|$)"
NAME_HINT = r"(?i)(^|_)name(_|$)|^(company|organization|org)$"
BOOLEAN_HINT = r"(?i)^(is|has|can)_|_(flag|enabled|active)$|^opt_"

# What each part of a format stands for: (text pattern, Spark pattern).
_PARTS = {
    "%Y": (r"\d{4}", "yyyy"), "%y": (r"\d{4}", "yyyy"), "%m": (r"\d{1,2}", "M"), "%d": (r"\d{1,2}", "d"), "%b": (r"[A-Za-z]{3}", "MMM"), "%B": (r"[A-Za-z]{3,9}", "MMMM"),
    "%H": (r"\d{1,2}", "H"), "%I": (r"\d{1,2}", "h"), "%M": (r"\d{1,2}", "m"), "%S": (r"\d{1,2}", "s"), "%p": (r"[AaPp][Mm]", "a"), "%f": (r"\d{1,6}", "[SSSSSS][SSSSS][SSSS][SSS][SS][S]"), "%z": (r"[+-]\d{2}:?\d{2}|Z", ""),
}
_SHORT_MONTHS = r"(?i)^(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)$"

# Formats in the order in which they are tried.
DATE_FORMATS = ["%Y-%m-%d", "%m/%d/%Y", "%d-%b-%Y", "%Y/%m/%d", "%B %d, %Y", "%m/%d/%y", "%d/%m/%Y", "%Y%m%d"]
DATETIME_FORMATS = [
    "%Y-%m-%dT%H:%M:%SZ", "%Y-%m-%dT%H:%M:%S%z", "%Y-%m-%dT%H:%M:%S.%f%z", "%Y-%m-%dT%H:%M:%S.%fZ", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S%z",
    "%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M", "%m/%d/%Y %H:%M:%S", "%m/%d/%Y %H:%M", "%d-%b-%Y %I:%M %p", "%d-%b-%Y %H:%M",
]
ISO_DATE = ["%Y-%m-%d"]
ISO_DATETIME = ["%Y-%m-%dT%H:%M:%SZ", "%Y-%m-%dT%H:%M:%S%z", "%Y-%m-%dT%H:%M:%S.%f%z", "%Y-%m-%dT%H:%M:%S.%fZ", "%Y-%m-%dT%H:%M:%S"]


def strip(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.btrim(c, F.lit(WHITE))


def strip_plain(c: Column) -> Column:
    """As strip, of a plain column: what has printable ASCII at both ends, as most cells have, is not looked at further."""
    last = F.substring(c, -1, 1)
    return F.when((c < "!") | (c >= "\x80") | (last < "!") | (last >= "\x80"), strip(c)).otherwise(c)


def present(v: Column) -> Column:
    return (v != "") & ~F.lower(v).isin(PLACEHOLDERS)


def null_like(raw: Column) -> Column:
    return raw.isNull() | ~present(strip(raw))


def format_pattern(fmt: str) -> str:
    """The texts that a format reads; a two-digit year is two digits here."""
    out = ""
    i = 0
    while i < len(fmt):
        part = fmt[i : i + 2]
        if part == "%y":
            out, i = out + r"\d{2}", i + 2
        elif part in _PARTS:
            out, i = out + f"(?:{_PARTS[part][0]})", i + 2
        else:
            out, i = out + ("\\" + fmt[i] if fmt[i] in ".+()" else fmt[i]), i + 1
    if fmt == "%Y%m%d":
        out = r"\d{8}"
    return f"^{out}$"


def parse_as(v: Column, fmt: str) -> Column:
    """The wall-clock time that a format reads in v (timestamp_ntz), null if none; a zone in the text stays aside."""
    text = v
    spark, i = "", 0
    while i < len(fmt):
        part = fmt[i : i + 2]
        if part in _PARTS:
            spark, i = spark + _PARTS[part][1], i + 2
        else:
            spark, i = spark + (f"'{fmt[i]}'" if fmt[i].isalpha() else fmt[i]), i + 1
    spark = "yyyyMMdd" if fmt == "%Y%m%d" else spark
    if fmt.endswith("%z"):
        text = F.regexp_replace(text, r"([+-]\d{2}:?\d{2}|Z)$", "")
    if "%y" in fmt:
        # Years from 69 on are of the last century.
        text = F.regexp_replace(F.regexp_replace(text, r"/(69|[7-9]\d)$", "/19$1"), r"/(\d{2})$", "/20$1")
    if "%f" in fmt:
        text = F.regexp_replace(text, r"\.\d{1,6}", "")
        spark = spark.replace("." + _PARTS["%f"][1], "")
    if "%p" in fmt:
        text = F.upper(text)
    parsed = F.try_to_timestamp(text, F.lit(spark)).cast("timestamp_ntz")
    return F.when(v.rlike(format_pattern(fmt)), parsed)


def first_format(v: Column, formats: list[str]) -> tuple[Column, Column]:
    """(time, format) of the first format that reads v. One pattern for all of them keeps other texts from being tried.

    What each format reads is one array that both results look into, so that no text is parsed twice.
    """
    likely = v.rlike("^(?:" + "|".join(format_pattern(f)[1:-1] for f in formats) + ")$")
    read = F.when(likely, F.array(*[parse_as(v, f) for f in formats]))
    each = [F.get(read, F.lit(k)) for k in range(len(formats))]
    return F.coalesce(*each), F.coalesce(*[F.when(ts.isNotNull(), F.lit(f)) for f, ts in zip(formats, each, strict=True)])


def zone_offset_minutes(v: Column) -> Column:
    """Minutes east of UTC of a zone at the end of a time; 0 for Z or none."""
    sign = F.regexp_extract(v, r"([+-])\d{2}:?\d{2}$", 1)
    hours, minutes = (F.coalesce(F.regexp_extract(v, r"[+-](\d{2}):?(\d{2})$", k).try_cast("int"), F.lit(0)) for k in (1, 2))
    return F.when(sign == "-", -1).otherwise(1) * (hours * 60 + minutes)


def _scaled(v: Column) -> Column:
    """The number behind a numeric text."""
    bare = F.regexp_replace(F.regexp_replace(v, r"^[A-Z]{3}\s", ""), r"^[$€£]\s?", "")
    last = F.substring(bare, -1, 1)
    factor = F.when(last == "M", 1e6).when(F.lower(last) == "k", 1e3).when(F.lower(last) == "b", 1e9).otherwise(1.0)
    return F.regexp_replace(bare, r"[,\s%MKkBb]", "").try_cast("double") * factor


def parse_number(v: Column) -> Column:
    """The number behind an integer, a decimal or a numeric text; null for anything else. 12% reads as 12."""
    return F.when(v.rlike(INTEGER) | v.rlike(DECIMAL), v.try_cast("double")).when(v.rlike(NUMERIC_TEXT), _scaled(v))


def tagged_number(v: Column, tag: Column) -> Column:
    """As parse_number, of a trimmed value whose tag is known: no label before these takes what their patterns read."""
    return F.when(tag.isin("integer", "decimal"), v.try_cast("double")).when(tag == "numeric_text", _scaled(v))


def phone_digits(v: Column) -> Column:
    digits = F.regexp_replace(v, r"\D", "")
    return F.when(v.rlike(PHONE) & F.length(digits).between(7, 15), digits)


def tag(raw: Column, fmt: Column | None = None, trimmed: bool = False) -> Column:
    """What a cell looks like, one of sixteen labels; a label is tried only on what no label before it takes.

    fmt: the format that reads the stripped cell, times first where there is a colon, if it is known already.
    trimmed: whether the cell is stripped already.
    """
    v = raw if trimmed else strip(raw)
    if fmt is None:
        is_time, is_date = first_format(v, DATETIME_FORMATS)[0].isNotNull(), first_format(v, DATE_FORMATS)[0].isNotNull()
    else:
        is_time, is_date = fmt.isin(DATETIME_FORMATS), fmt.isin(DATE_FORMATS)
    digits = phone_digits(v)
    # Dates are parsed only where a digit and a separator leave them possible.
    dated = (
        F.when(v.contains(":") & is_time, "datetime")
        .when(is_date, "date")
        .when(digits.isNotNull(), F.when(F.length(digits) >= 10, "phone").otherwise("phone_short"))
        .when(v.rlike(PHONE), "phone_short")
    )
    return (
        F.when(raw.isNull() | (v == ""), "blank")
        .when(F.lower(v).isin(PLACEHOLDERS), "placeholder")
        .when(v.rlike(INTEGER), "integer")
        .when(v.rlike(DECIMAL), "decimal")
        .when(v.contains("@"), F.when(v.rlike(EMAIL), "email").otherwise("email_malformed"))
        .when(v.rlike(URL), "url")
        .when(v.rlike(IDENTIFIER), "identifier")
        .when(v.rlike(NUMERIC_TEXT), "numeric_text")
        .otherwise(
            F.coalesce(
                F.when(v.rlike(r"\p{Nd}"), dated),
                F.when(v.rlike(CODE), "code").when(v.rlike(URL_NO_SCHEME), "url_no_scheme").when(F.lower(v).contains(" at ") & v.contains("."), "email_malformed").otherwise("text"),
            )
        )
    )


def shape(v: Column, limit: int = 24) -> Column:
    """Digits to 9, upper-case letters to A, other letters to a; longer texts end in an ellipsis."""
    head = F.substring(v, 1, limit)
    for pattern, to in ((r"\p{Lu}", "A"), (r"[\p{Ll}\p{Lt}\p{Lm}\p{Lo}]", "a"), (r"\p{Nd}", "9")):
        head = F.regexp_replace(head, pattern, to)
    return F.when(F.length(v) > limit, F.concat(head, F.lit("…"))).otherwise(head)


def norm_key(v: Column) -> Column:
    """Lower case, white space collapsed, blanks and .,; off the ends."""
    return F.btrim(F.regexp_replace(F.lower(v), r"(?U)\s+", " "), F.lit(" .,;"))


def truncate(v: Column, limit: int = 60) -> Column:
    return F.when(F.length(v) > limit, F.concat(F.substring(v, 1, limit - 1), F.lit("…"))).otherwise(v)


def percent(part: Column, whole: Column) -> Column:
    """To one place; 0 of nothing."""
    return F.when(whole == 0, 0.0).otherwise(F.bround(100.0 * part / whole, 1))
