"""Column profiles. Cells are grouped by distinct trimmed value first, so that each value is classified once."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayside.functions import cells
from quayside.plans.shared import Stages, barrier

TAGS = ["blank", "placeholder", "integer", "decimal", "numeric_text", "date", "datetime", "email", "email_malformed", "url", "url_no_scheme", "phone", "phone_short", "identifier", "code", "text"]
TOP_VALUES, FULL_COUNTS, SAMPLES, TOP_SHAPES, VARIANTS, EXAMPLES = 10, 50, 5, 5, 10, 5


def key(df: DataFrame) -> list[str]:
    """What a column is known by: its name, and that of its table where the values are of several."""
    return [c for c in ("src", "col") if c in df.columns]


def _numbered(df: DataFrame, row_idx: str, begin: int) -> DataFrame:
    """(_row, _column, raw): each cell, its column by number, from begin on."""
    text = F.array(*[F.col(c).cast("string") for c in df.columns if c != row_idx]).cast("array<string>")
    return df.select(F.col(row_idx).cast("long").alias("_row"), F.posexplode(text).alias("_at", "raw")).select("_row", (F.col("_at") + F.lit(begin)).alias("_column"), "raw")


def _valued(frames: dict[str, DataFrame], row_idx: str) -> DataFrame:
    """The value tables of frames as one, with src."""
    named = [(name, c, i) for name, df in frames.items() for i, c in enumerate(c for c in df.columns if c != row_idx)]
    cells_, begin = None, 0
    for df in frames.values():
        own = _numbered(df, row_idx, begin)
        cells_, begin = own if cells_ is None else cells_.unionByName(own), begin + len(df.columns) - 1
    v, raw = cells.strip_plain(F.col("raw")), F.col("raw")
    stray = (raw != F.col("v")) | raw.contains("  ")
    out = cells_.withColumn("v", v).groupBy("_column", "v").agg(F.count("*").alias("n"), F.min("_row").alias("first"), F.count_if(stray).alias("stray"))
    of = lambda k, kind: F.get(F.array(*[F.lit(x[k]) for x in named]).cast(f"array<{kind}>"), F.col("_column"))
    return with_dates(out).select(of(0, "string").alias("src"), of(1, "string").alias("col"), of(2, "int").alias("pos"), "v", cells.tag(F.col("v"), F.col("fmt"), trimmed=True).alias("tag"), "n", "first", "stray", "at", "fmt")


def value_table(df: DataFrame, row_idx: str = "row_idx") -> DataFrame:
    """(col, pos, v, tag, n, first, stray, at, fmt): each distinct trimmed value of each column, its rows and its first row.

    stray: rows with white space at the ends of the cell or doubled in it. at and fmt are the time in a value and the
    format that reads it, found once for the tag and for all facts of dates. One scan and one shuffle on the value and its
    column, by number, with partial sums before it; a value that fills a column is one row.
    """
    return _valued({"": df}, row_idx).drop("src")


def value_tables(frames: dict[str, DataFrame], row_idx: str = "row_idx") -> DataFrame:
    """The value tables of several tables as one, by src, their names: one shuffle and one plan, however many they are."""
    return _valued(frames, row_idx)


def present(values: DataFrame) -> DataFrame:
    """Values that say something: (col, v, tag, n, first, at, fmt)."""
    return values.where("tag not in ('blank', 'placeholder')").select(*key(values), "v", "tag", "at", "fmt", "n", "first")


def tag_counts(values: DataFrame) -> DataFrame:
    return values.groupBy(*key(values), "tag").agg(F.sum("n").alias("n"))


def _n(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))


def _said() -> Column:
    return ~F.col("tag").isin("blank", "placeholder")


def null_facts(values: DataFrame) -> DataFrame:
    """Per column: rows, non-null, blank and placeholder cells, stray white space, longest trimmed text."""
    facts = ["pos", "n_rows", "non_null", "blank", "placeholder", "whitespace", "max_length"]
    return column_facts(values).select(*key(values), *facts)


def value_facts(values: DataFrame, as_of: str = "9999-12-31") -> DataFrame:
    """Per column that has any, all that its values tell; what a caller leaves out is not computed."""
    return _facts(values, as_of).where("said is not null")


def _facts(values: DataFrame, as_of: str) -> DataFrame:
    """null_facts and value_facts of each column in one pass: values are summed up by column and tag, then those few rows by column."""
    truth = F.when(F.length("v") <= max(map(len, cells.TRUE_WORDS + cells.FALSE_WORDS)), F.when(F.lower("v").isin(cells.TRUE_WORDS), True).when(F.lower("v").isin(cells.FALSE_WORDS), False))
    own = values.withColumns({"number": cells.tagged_number(F.col("v"), F.col("tag")), "digits": cells.phone_digits(F.col("v")), "truth": truth, "folded": F.lower("v")})
    c, n, is_, numbers = F.col, F.col("n"), lambda *tags: F.col("tag").isin(*tags), F.col("number").isNotNull()
    short = c("digits").isNull() | (F.length("digits") < 10)
    most = lambda truth: F.max(F.when(truth, n))
    ever = lambda condition: F.max(F.coalesce(condition, F.lit(False)).cast("int"))
    by_tag = own.groupBy(*key(own), "tag").agg(
        F.any_value("pos").alias("pos"), F.sum("n").alias("n"), F.count("*").alias("held"), F.sum("stray").alias("stray"), F.max(F.length("v")).alias("longest"),
        F.min("number").alias("min"), F.max("number").alias("max"), F.sum(c("number") * n).alias("total"), _n(numbers).alias("numbers"), _n(c("number") != F.floor("number")).alias("fractional"),
        _n(c("fmt").isNotNull()).alias("dates"), F.collect_set("fmt").alias("formats"), _n(c("fmt").isin(cells.ISO_DATE)).alias("iso_dates"), _n(c("fmt").isin(cells.ISO_DATETIME)).alias("iso_datetimes"),
        _n(c("at").cast("date") > F.lit(as_of).cast("date")).alias("future"), F.min("at").alias("min_at"), F.max("at").alias("max_at"),
        _n(c("v") != c("folded")).alias("capitals"), _n(short).alias("bad_phone"), _n(~short & c("v").rlike(r"^\+\d+$")).alias("e164"),
        most(c("truth")).alias("yes"), most(~c("truth")).alias("no"), _n(c("truth").isNull()).alias("not_boolean"),
        ever(c("truth").isNull()).alias("other_words"), ever(~c("v").isin("0", "1")).alias("beyond_01"), ever(c("number") != F.floor("number")).alias("fractions"),
    )
    said = _said()
    sum_ = lambda name: F.sum(F.when(said, c(name)))
    least, greatest = (lambda name: F.min(F.when(said, c(name)))), (lambda name: F.max(F.when(said, c(name))))
    rest = lambda name: (F.coalesce(sum_("n"), F.lit(0)) - F.coalesce(sum_(name), F.lit(0))).alias(f"bad_{name[:-1]}")
    whole = lambda name: F.coalesce(sum_(name), F.lit(0)).alias(name)
    return by_tag.groupBy(*key(own)).agg(
        F.any_value("pos").alias("pos"), F.sum("n").alias("n_rows"), _n(said).alias("non_null"), _n(is_("blank")).alias("blank"), _n(is_("placeholder")).alias("placeholder"),
        F.coalesce(sum_("stray"), F.lit(0)).alias("whitespace"), F.coalesce(greatest("longest"), F.lit(0)).cast("long").alias("max_length"),
        sum_("n").alias("said"), sum_("held").alias("distinct_count"), cells.percent(sum_("held"), sum_("n")).alias("unique_pct"),
        least("min").alias("min"), greatest("max").alias("max"), F.bround(sum_("total") / F.sum(F.when(c("numbers") > 0, c("numbers"))), 2).alias("mean"), whole("numbers"), rest("numbers"),
        _n(is_("numeric_text")).alias("numeric_text"), _n(is_("decimal")).alias("decimals"), whole("fractional"),
        whole("dates"), rest("dates"), F.size(F.array_distinct(F.flatten(F.collect_list(F.when(said, c("formats")))))).cast("long").alias("n_formats"), whole("iso_dates"), whole("iso_datetimes"),
        whole("future"), least("min_at").alias("min_at"), greatest("max_at").alias("max_at"),
        _n(said & ~is_("email")).alias("bad_email"), F.coalesce(F.sum(F.when(is_("email"), c("capitals"))), F.lit(0)).alias("uppercase"), _n(is_("url_no_scheme")).alias("no_scheme"), _n(said & ~is_("url", "url_no_scheme")).alias("bad_url"),
        whole("bad_phone"), whole("e164"), _n(said & ~is_("identifier", "integer", "code")).alias("bad_identifier"),
        (sum_("n") - F.coalesce(greatest("yes"), F.lit(0)) - F.coalesce(greatest("no"), F.lit(0))).alias("variants"), whole("not_boolean"),
        greatest("other_words").alias("other_words"), greatest("beyond_01").alias("beyond_01"), greatest("fractions").alias("fractions"),
        *[_n(is_(t)).alias(f"t_{t}") for t in TAGS[2:]],
    )


def distinct_facts(values: DataFrame) -> DataFrame:
    return value_facts(values).select(*key(values), "distinct_count", "unique_pct")


def _ranked(df: DataFrame, keep: int, *order: Column) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*key(df)).orderBy(*order))).where(F.col("rank") <= keep)


def top_values(values: DataFrame, keep: int = TOP_VALUES) -> DataFrame:
    """The most common values; equal counts by first appearance."""
    return _ranked(present(values), keep, F.desc("n"), F.asc("first")).select(*key(values), "rank", "v", "n")


def value_counts(values: DataFrame, up_to: int = FULL_COUNTS) -> DataFrame:
    """All values of the columns with no more than `up_to` of them."""
    own = present(values)
    small = own.groupBy(*key(own)).count().where(F.col("count") <= up_to).drop("count")
    return own.join(small, key(own), "left_semi").select(*key(own), "v", "n")


def first_distinct(values: DataFrame, keep: int = SAMPLES) -> DataFrame:
    return _ranked(present(values), keep, F.asc("first")).select(*key(values), "rank", cells.truncate(F.col("v")).alias("v"))


def shapes(values: DataFrame, keep: int = TOP_SHAPES) -> DataFrame:
    """The most common shapes with their first example."""
    own = present(values).groupBy(*key(values), cells.shape(F.col("v")).alias("shape")).agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.min_by("v", "first").alias("example"))
    return _ranked(own, keep, F.desc("n"), F.asc("first")).select(*key(values), "rank", "shape", "n", cells.truncate(F.col("example")).alias("example"))


def case_variants(values: DataFrame) -> DataFrame:
    """Groups of values that differ only in case."""
    spellings = present(values).groupBy(*key(values), F.lower("v").alias("folded")).agg(F.count("*").alias("n_spellings"), F.sort_array(F.collect_set("v")).alias("spellings"))
    return spellings.where("n_spellings > 1").select(*key(values), "folded", "n_spellings", F.array_join("spellings", " / ").alias("spellings"))


def number_stats(values: DataFrame) -> DataFrame:
    return value_facts(values).select(*key(values), "min", "max", "mean", F.col("numbers").alias("parsed"), F.col("bad_number").alias("malformed"), "numeric_text", "decimals", "fractional")


def with_dates(df: DataFrame) -> DataFrame:
    """Adds (at, fmt): times before dates where there is a colon, dates first elsewhere."""
    v = F.col("v")
    time, time_fmt = cells.first_format(v, cells.DATETIME_FORMATS)
    date, date_fmt = cells.first_format(v, cells.DATE_FORMATS)
    both = df.withColumns({"_t": time, "_tf": time_fmt, "_d": date, "_df": date_fmt})
    timed = F.col("_t").isNotNull() & (v.contains(":") | F.col("_d").isNull())
    return both.withColumns({"at": F.when(timed, F.col("_t")).otherwise(F.col("_d")), "fmt": F.when(timed, F.col("_tf")).otherwise(F.col("_df"))}).drop("_t", "_tf", "_d", "_df")


def date_formats(values: DataFrame) -> DataFrame:
    return present(values).where("fmt is not null").groupBy(*key(values), "fmt").agg(F.sum("n").alias("n"))


def date_stats(values: DataFrame, as_of: str) -> DataFrame:
    return value_facts(values, as_of).select(*key(values), F.col("dates").alias("parsed"), F.col("bad_date").alias("malformed"), "n_formats", "iso_dates", "iso_datetimes", "future", "min_at", "max_at")


def email_stats(values: DataFrame) -> DataFrame:
    return value_facts(values).select(*key(values), F.col("bad_email").alias("malformed"), "uppercase")


def url_stats(values: DataFrame) -> DataFrame:
    return value_facts(values).select(*key(values), "no_scheme", F.col("bad_url").alias("malformed"))


def phone_stats(values: DataFrame) -> DataFrame:
    return value_facts(values).select(*key(values), F.col("bad_phone").alias("malformed"), "e164")


def boolean_stats(values: DataFrame) -> DataFrame:
    """Spellings, and cells that use neither the commonest spelling of true nor that of false."""
    return value_facts(values).select(*key(values), F.col("distinct_count").alias("spellings"), "variants", "not_boolean")


def malformed_examples(values: DataFrame, keep: int = EXAMPLES) -> DataFrame:
    """The first values, by row, that a column's inferred type cannot read."""
    own = present(values).withColumns({"number": cells.tagged_number(F.col("v"), F.col("tag")), "digits": cells.phone_digits(F.col("v"))})
    own = own.join(column_types(values).drop("pos"), key(values))
    kind, tag = F.col("inferred_type"), F.col("tag")
    bad = (
        F.when(kind.isin("integer", "decimal"), ~tag.isin("integer", "decimal", "numeric_text") | F.col("number").isNull())
        .when(kind.isin("date", "datetime"), F.col("fmt").isNull())
        .when(kind == "email", tag != "email")
        .when(kind == "url", ~tag.isin("url", "url_no_scheme"))
        .when(kind == "phone", F.col("digits").isNull() | (F.length("digits") < 10))
        .when(kind == "identifier", ~tag.isin("identifier", "integer", "code"))
    )
    return _ranked(own.where(bad), keep, F.asc("first")).select(*key(values), "rank", cells.truncate(F.col("v")).alias("v"))


def json_types(records: DataFrame) -> DataFrame:
    """(col, raw_type, n) of the values in JSON records (record), as the export has them; nulls are none."""
    v = F.try_parse_json("record")
    each = records.select(v.alias("v"), F.explode(F.json_object_keys("record")).alias("col"))
    kind = F.schema_of_variant(F.try_variant_get("v", F.concat(F.lit("$['"), "col", F.lit("']")), "variant"))
    names = [("STRING", "text"), ("BOOLEAN", "boolean"), ("BIGINT", "integer"), ("DECIMAL", "decimal"), ("DOUBLE", "decimal"), ("ARRAY", "list"), ("OBJECT", "object")]
    raw = F.lit(None).cast("string")
    for start, name in names:
        raw = F.when(F.startswith(kind, F.lit(start)), name).otherwise(raw)
    return each.select("col", raw.alias("raw_type")).where("raw_type is not null").groupBy("col", "raw_type").agg(F.count("*").alias("n"))


def type_issues(types: DataFrame, facts: DataFrame) -> DataFrame:
    """mixed_json_types: columns with values of several JSON types, and how many are not of the commonest. facts: col, non_null."""
    mixed = types.groupBy("col").agg(F.count("*").alias("kinds"), F.max("n").alias("most")).where("kinds > 1").join(facts.select("col", "non_null"), "col")
    return mixed.select(F.col("col").alias("column"), F.lit("mixed_json_types").alias("code"), F.lit("warning").alias("severity"), (F.col("non_null") - F.col("most")).alias("count")).where("count > 0")


def reference_issues(references: DataFrame) -> DataFrame:
    """orphan_references of references (column, orphans): values that point at nothing."""
    return references.where("orphans > 0").select("column", F.lit("orphan_references").alias("code"), F.lit("error").alias("severity"), F.col("orphans").cast("long").alias("count"))


def normalized_duplicates(values: DataFrame) -> DataFrame:
    own = present(values).groupBy(*key(values), cells.norm_key(F.col("v")).alias("k")).agg(F.sum("n").alias("n"))
    return own.groupBy(*key(own)).agg((F.sum("n") - F.count("*")).alias("duplicates"))


def exact_duplicates(df: DataFrame, *ignored: str) -> DataFrame:
    """Rows beyond the first of equal rows."""
    own = df.select(F.struct(*[F.col(c) for c in df.columns if c not in ignored]).alias("row")).groupBy("row").count()
    return own.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicate_rows"))


def inferred_type() -> Column:
    """A column's type by the tags that dominate its value_facts."""
    share = lambda *tags: sum((F.col(f"t_{t}") for t in tags), F.lit(0)) / F.col("said")
    named = lambda pattern: F.col("col").rlike(pattern)
    numeric = share("integer", "decimal", "numeric_text")
    all_integers = F.col("t_decimal") + F.col("t_numeric_text") == 0
    return (
        F.when(F.col("said").isNull(), "empty")
        .when((F.col("other_words") == 0) & ((F.col("beyond_01") == 1) | named(cells.BOOLEAN_HINT)), "boolean")
        .when(named(cells.PHONE_HINT) & (share("phone", "phone_short", "integer") >= 0.6), "phone")
        .when(share("identifier") >= 0.6, "identifier")
        .when(numeric >= 0.6, F.when(all_integers, F.when(named(cells.KEY_HINT), "identifier").otherwise("integer")).when(F.col("fractions") == 0, "integer").otherwise("decimal"))
        .when(share("date", "datetime") >= 0.6, F.when(F.col("t_datetime") >= F.col("t_date"), "datetime").otherwise("date"))
        .when(share("email", "email_malformed") >= 0.6, "email")
        .when(share("url", "url_no_scheme") >= 0.6, "url")
        .when(share("phone", "phone_short") >= 0.6, "phone")
        .when(share("code") >= 0.6, "code")
        .when((F.col("distinct_count") <= 25) & (F.col("said") >= 20) & (F.col("distinct_count") / F.col("said") <= 0.1), "category")
        .otherwise("text")
    )


def column_facts(values: DataFrame, as_of: str = "9999-12-31") -> DataFrame:
    """One row per column: null facts, value facts and the inferred type, from one pass over the values."""
    return _facts(values, as_of).withColumn("inferred_type", inferred_type()).fillna({"distinct_count": 0, "unique_pct": 0.0})


def column_types(values: DataFrame) -> DataFrame:
    """(col, pos, inferred_type); one row for each column."""
    return column_facts(values).select(*key(values), "pos", "inferred_type")


def with_key(facts: DataFrame) -> DataFrame:
    """column_facts with missing (null-like) and duplicate values, and whether the column is the key of the table."""
    fits = F.col("col").rlike(cells.KEY_HINT) & F.col("inferred_type").isin("identifier", "integer", "code", "text") & (F.col("unique_pct") >= 90) & (cells.percent(F.col("n_rows") - F.col("non_null"), F.col("n_rows")) <= 20)
    # One row per column of the table meets here.
    best = F.row_number().over(Window.partitionBy(*([c for c in key(facts) if c == "src"] or [F.lit(1)])).orderBy(F.desc(fits), F.desc("unique_pct"), "pos"))
    return facts.withColumns({"is_key": fits & (best == 1), "missing": F.col("n_rows") - F.col("non_null"), "key_duplicates": F.col("non_null") - F.col("distinct_count")})


def key_facts(values: DataFrame) -> DataFrame:
    return with_key(column_facts(values)).select(*key(values), "missing", F.col("key_duplicates").alias("duplicates"), "is_key")


def references(frames: dict[str, DataFrame], keys: dict[str, str], row_idx: str = "row_idx") -> DataFrame:
    """Each table's key looked up in every other table that has a column of that name, unless that is its own key.

    (child, column, references, checked, resolved, orphans, orphan_pct, examples): cells by row, and the first orphans by
    row. One inverted index holds, for each value, the columns that have it; all pairs are counted from that in one
    aggregate, however many there are. keys: the key column by table.
    """
    spark = next(iter(frames.values())).sparkSession
    pairs = [(child, parent, key) for child, df in frames.items() for parent, key in keys.items() if parent != child and key in df.columns and keys.get(child) != key]
    asked = spark.createDataFrame(pairs, "child string, parent string, column string")
    held = None
    for name, df in frames.items():
        columns = sorted({c for c in df.columns if c in keys.values() and c != row_idx})
        if not columns or name not in {x for child, parent, _ in pairs for x in (child, parent)}:
            continue
        row = F.col(row_idx).cast("long") if row_idx in df.columns else F.lit(0).cast("long")
        cells_ = df.select(row.alias("_row"), *[F.col(c).cast("string").alias(c) for c in columns]).unpivot(["_row"], columns, "column", "raw")
        own = cells_.where(~cells.null_like(F.col("raw"))).groupBy("column", cells.strip(F.col("raw")).alias("v")).agg(F.count("*").alias("n"), F.min("_row").alias("first"))
        own = own.select(F.lit(name).alias("table"), "column", "v", "n", "first")
        held = own if held is None else held.unionByName(own)
    if held is None:
        held = spark.createDataFrame([], "table string, column string, v string, n long, first long")
    stages = Stages(spark, "references")
    index = held.groupBy("v").agg(F.collect_list(F.struct("table", "column", "n", "first")).alias("held"))  # as many as there are columns
    each = index.select("v", "held", F.explode("held").alias("h")).join(F.broadcast(asked), (F.col("h.table") == F.col("child")) & (F.col("h.column") == F.col("column")))
    there = F.exists("held", lambda x: (x["table"] == F.col("parent")) & (x["column"] == F.col("column")))
    pair = ["child", "column", "parent"]
    each = stages.write(each.select(*pair, "v", "h.n", "h.first", there.alias("there")), "looked-up")
    counts = each.groupBy(*pair).agg(F.sum("n").alias("checked"), F.sum(F.when(F.col("there"), F.col("n")).otherwise(0)).alias("resolved"))
    nth = F.row_number().over(Window.partitionBy(*pair).orderBy("first", "v"))
    firsts = each.where("not there").withColumn("nth", nth).where(F.col("nth") <= EXAMPLES)
    firsts = firsts.groupBy(*pair).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("nth", "v"))), lambda x: x["v"]), ", ").alias("examples"))
    out = asked.join(counts, pair, "left").join(firsts, pair, "left").fillna(0, ["checked", "resolved"]).fillna("", ["examples"])
    orphans = F.col("checked") - F.col("resolved")
    return out.select("child", "column", F.concat_ws(".", "parent", "column").alias("references"), "checked", "resolved", orphans.alias("orphans"), cells.percent(orphans, F.col("checked")).alias("orphan_pct"), "examples")


def check_reference(child: DataFrame, parent: DataFrame, key: str, row_idx: str = "row_idx") -> DataFrame:
    """One row: the references of child's `key` to that of parent."""
    return references({"child": child, "parent": parent}, {"parent": key}, row_idx).drop("child", "column", "references")


def infer_references(frames: dict[str, DataFrame], row_idx: str = "row_idx") -> DataFrame:
    """`references` with the key that each table's profile finds; one job for the keys of all tables."""
    found = key_facts(barrier(value_tables(frames, row_idx), "values")).where("is_key").select("src", "col")
    return references(frames, {r["src"]: r["col"] for r in found.collect()}, row_idx)


def profile_table(values: DataFrame) -> DataFrame:
    """One row per column: type, null and distinct facts."""
    null_count = F.col("blank") + F.col("placeholder")
    return column_facts(values).select(*key(values), F.col("pos").cast("long").alias("pos"), "inferred_type", "non_null", null_count.alias("null_count"), cells.percent(null_count, F.col("n_rows")).alias("null_pct"), "distinct_count", "unique_pct", "whitespace", "max_length")


def quality_issues(df: DataFrame, as_of: str, row_idx: str = "row_idx") -> DataFrame:
    """(column, code, severity, count) for whatever is wrong, errors and large counts first.

    Distinct values are classified once and written; all facts of all columns are aggregates over that table.
    """
    values = barrier(value_table(df, row_idx), "values")
    variants = case_variants(values).groupBy("col").agg(F.count("*").alias("case_groups"))
    f = with_key(column_facts(values, as_of)).join(normalized_duplicates(values), "col", "left").join(variants, "col", "left")
    f = barrier(f, "facts")
    kind, n_rows = F.col("inferred_type"), F.col("n_rows")
    is_ = lambda *kinds: kind.isin(*kinds)
    null_count = F.col("blank") + F.col("placeholder")
    bad = F.when(is_("integer", "decimal"), F.col("bad_number")).when(is_("date", "datetime"), F.col("bad_date")).when(is_("email"), F.col("bad_email")).when(is_("url"), F.col("bad_url")).when(is_("phone"), F.col("bad_phone")).when(is_("identifier"), F.col("bad_identifier"))
    iso = F.when(is_("date"), F.col("iso_dates")).otherwise(F.col("iso_datetimes"))
    dated, filled = is_("date", "datetime"), kind != "empty"
    named = kind.isin("email") | F.col("col").rlike(cells.NAME_HINT)
    rows = [
        ("key_missing", "error", F.when(F.col("is_key"), F.col("missing"))),
        ("key_duplicates", "error", F.when(F.col("is_key"), F.col("key_duplicates"))),
        ("empty_column", "info", F.when(~filled, n_rows)),
        ("null_rate_high", "warning", F.when(filled & (cells.percent(null_count, n_rows) >= 20), null_count)),
        ("placeholder_values", "warning", F.when(filled, F.col("placeholder"))),
        (F.concat(F.lit("malformed_"), kind), F.when(is_("email", "identifier"), "error").otherwise("warning"), bad),
        ("mixed_date_formats", "warning", F.when(dated & (F.col("n_formats") > 1), F.col("dates") - iso)),
        ("future_dates", "warning", F.when(dated, F.col("future"))),
        ("numeric_text", "warning", F.when(is_("integer", "decimal"), F.col("numeric_text"))),
        ("float_text", "info", F.when(is_("integer"), F.col("decimals"))),
        ("uppercase_emails", "info", F.when(is_("email"), F.col("uppercase"))),
        ("url_no_scheme", "info", F.when(is_("url"), F.col("no_scheme"))),
        ("phone_not_e164", "info", F.when(is_("phone"), F.col("non_null") - F.col("e164") - F.col("bad_phone"))),
        ("boolean_spellings", "info", F.when(is_("boolean") & (F.col("distinct_count") > 2), F.col("variants"))),
        ("case_variants", "info", F.when(is_("category", "code", "text", "email"), F.col("case_groups"))),
        ("whitespace", "info", F.when(filled, F.col("whitespace"))),
        ("normalized_duplicates", "warning", F.when(named & (F.col("unique_pct") >= 50), F.col("duplicates"))),
    ]
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    issues = F.explode(F.array(*[F.struct(lit(code).alias("code"), lit(severity).alias("severity"), n.cast("long").alias("count")) for code, severity, n in rows]))
    out = f.select(F.col("col").alias("column"), issues.alias("i")).select("column", "i.*").where("count > 0")
    whole = exact_duplicates(df, row_idx)
    no_key = f.agg(F.max(F.coalesce(F.col("is_key"), F.lit(False)).cast("int")).alias("k"), F.max("n_rows").alias("n")).where("k = 0").select(F.lit(None).cast("string").alias("column"), F.lit("no_key_column").alias("code"), F.lit("warning").alias("severity"), F.col("n").alias("count"))
    copies = whole.where("duplicate_rows > 0").select(F.lit(None).cast("string").alias("column"), F.lit("duplicate_rows").alias("code"), F.lit("warning").alias("severity"), F.col("duplicate_rows").alias("count"))
    order = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return out.unionByName(no_key).unionByName(copies).orderBy(order, F.desc("count"), "code", "column")


def name_has(pattern: str, name: str) -> bool:
    return re.search(pattern, name) is not None
