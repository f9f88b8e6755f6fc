"""Records of text files that are read in ranges, though what a range begins with depends on all before it.

A range of a file is read line by line. A line takes what is before it from one of two states (outside or inside quotes)
to another, so it is a map of two states, and so is a range of lines. What a line does to each state is found by itself;
maps are composed within ranges, then ranges within a file, one row for each. Each line then knows its state, hence
which lines begin a record. Lines of a record that spans several are put together; no other line moves for it.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quayside.plans.shared import Stages, small

#: Bytes of a row for each range, about.
RANGE_BYTES = 300


def lines(spark: SparkSession, path: str, separator: str = "\n") -> DataFrame:
    """(file, start, id, value): what is between separators, the range of the file it begins in, and its order there."""
    text = spark.read.option("lineSep", separator).text(path)
    return text.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("id"),
        "value",
    )


def entered(rows: DataFrame, by: WindowSpec) -> DataFrame:
    """Adds in0 and in1: the state in which a row is entered if the first row of its group is entered outside, or inside.

    to0 and to1 are the states in which a row leaves what enters it outside, or inside. The last row before that leaves
    both in one state decides, and the rows since then that swap them.
    """
    fixed, swap = F.col("to0") == F.col("to1"), (F.col("to0") & ~F.col("to1")).cast("int")
    rows = rows.withColumn("_swaps", so_far(swap, by))
    last = F.last(F.when(fixed, F.struct(F.col("to0").alias("state"), F.col("_swaps").alias("swaps"))), ignorenulls=True).over(by.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumns({"_last": last, "_before": F.col("_swaps") - swap})
    odd = F.pmod(F.col("_before") - F.coalesce("_last.swaps", F.lit(0)), F.lit(2)) == 1
    in0 = F.coalesce("_last.state", F.lit(False)) != odd
    return rows.withColumns({"in0": in0, "in1": F.when(F.col("_last").isNull(), ~in0).otherwise(in0)}).drop("_swaps", "_last", "_before")


def left(state: str) -> Column:
    return F.when(F.col(state), F.col("to1")).otherwise(F.col("to0"))


def in_range() -> WindowSpec:
    return W.partitionBy("file", "start").orderBy("id")


def in_file() -> WindowSpec:
    return W.partitionBy("file").orderBy("start")


def in_all() -> WindowSpec:
    """Over one row for each range."""
    return W.orderBy("file", "start")


def so_far(column: Column, by: WindowSpec) -> Column:
    return F.sum(column).over(by.rowsBetween(W.unboundedPreceding, 0))


def summed(column: Column, by: WindowSpec) -> Column:
    """Sum over the rows before."""
    return F.coalesce(F.sum(column).over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))


def of_ranges(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """rows with the columns of their range. A row without one means that the files or the size of ranges have changed."""
    return rows.join(small(ranges, RANGE_BYTES), ["file", "start"], "left")


def put_together(parts: DataFrame, separator: str) -> DataFrame:
    """(record, value) of parts (record, start, id, value, whole): whole ones as they are, the others in their order."""
    several = parts.where("not whole").groupBy("record").agg(F.array_sort(F.collect_list(F.struct("start", "id", "value"))).alias("parts"))
    several = several.select("record", F.array_join(F.transform("parts", lambda p: p["value"]), separator).alias("value"))
    return parts.where("whole").select("record", "value").unionByName(several)


class Unreadable(ValueError):
    pass


# --- delimited text --------------------------------------------------------------------------------


def opens(line: Column, delimiter: str = ",") -> Column:
    """Whether a line that begins outside quotes ends inside a quoted cell: whole cells, then a quote that nothing closes."""
    d = "\\" + delimiter
    return line.rlike(rf'^(?:(?:"(?:[^"]++|"")*+"[^{d}]*+|[^"{d}][^{d}]*+)?+{d})*+"(?:[^"]++|"")*+$')


def delimited_records(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """(record, value): records of delimited text after the first of each file, its header; blank lines are none.

    Where no line leaves a quote open, every line is a record, and one scan for that is all there is besides the
    numbering. Else lines take their state from the lines before them.
    """
    text = lines(spark, path).withColumn("value", F.regexp_replace("value", "\r$", ""))
    blank = ~F.col("value").rlike(r"[^\x00-\x20]")
    quoted = F.when(F.col("value").contains('"'), opens(F.col("value"), delimiter)).otherwise(F.lit(False))
    stages = Stages(spark, "delimited")
    count = F.count_if
    seen = text.groupBy("file", "start").agg(F.min("id").alias("first"), F.count("*").alias("n"), count(blank).alias("blanks"), count(quoted).alias("open"))
    seen = stages.write(seen, "ranges")
    blanks, open_ = seen.agg(F.sum("blanks"), F.sum("open")).first()
    if not blanks and not open_:
        header = (F.col("start") == 0).cast("long")
        ranges = seen.select("file", "start", "first", (summed(F.col("n") - header, in_all()) - header).alias("base"))
        ranges = stages.write(ranges, "bases")
        at = F.coalesce(F.col("base") + F.col("id") - F.col("first"), F.raise_error(F.lit("the files have changed while they were read")).cast("long"))
        rows = of_ranges(text, ranges).where((F.col("start") > 0) | (F.col("id") > F.col("first")) | F.col("first").isNull())
        return rows.select(at.alias("record"), "value")
    both = text.withColumns({"to0": quoted, "to1": opens(F.concat(F.lit('"'), F.col("value")), delimiter), "blank": blank})
    both = entered(both, in_range())
    begun = {f"n{k}": so_far((~F.col(f"in{k}") & ~F.col("blank")).cast("long"), in_range()) for k in (0, 1)}
    held = stages.write(both.withColumns({**begun, "out0": left("in0"), "out1": left("in1")}), "lines")
    ranges = held.groupBy("file", "start").agg(F.max_by("out0", "id").alias("to0"), F.max_by("out1", "id").alias("to1"), F.max("n0").alias("n0"), F.max("n1").alias("n1"))
    ranges = entered(ranges, in_file()).withColumn("base", summed(F.when(F.col("in0"), F.col("n1")).otherwise(F.col("n0")), in_all()))
    ranges = ranges.withColumns({"header": F.min("base").over(W.partitionBy("file")), "headers": F.dense_rank().over(W.orderBy("file"))})
    ranges = stages.write(ranges, "entered")
    if not ranges.groupBy("file").agg(F.max_by(left("in0"), "start").alias("open")).where("open").isEmpty():
        raise Unreadable(f"{path} ends inside a quoted cell")
    whole = of_ranges(held, ranges.select("file", "start", F.col("in0").alias("inside_first"), "base", "header", "headers"))
    pick = lambda k: F.when(F.col("inside_first"), F.col(f"{k}1")).otherwise(F.col(f"{k}0"))
    marked = whole.withColumns({"inside": pick("in"), "after": pick("out"), "record": F.col("base") + pick("n") - 1})
    marked = marked.where((F.col("inside") | ~F.col("blank")) & (F.col("record") > F.col("header")))
    marked = marked.withColumns({"record": F.col("record") - F.col("headers"), "whole": ~F.col("inside") & ~F.col("after")})
    return put_together(marked.select("record", "start", "id", "value", "whole"), "\n")


# --- lists of JSON objects -------------------------------------------------------------------------


def _outside(text: Column) -> Column:
    """What is not in strings, of text that begins outside one and has no escapes."""
    return F.regexp_replace(text, '"[^"]*+(?:"|$)', "")


def _deeper(text: Column) -> Column:
    """By how much brackets and braces go deeper in text without strings."""
    return (F.regexp_count(text, F.lit(r"[\[{]")) - F.regexp_count(text, F.lit(r"[\]}]"))).cast("long")


def json_records(spark: SparkSession, path: str, key: str = "data") -> DataFrame:
    """(record, value): the objects of a list, bare or under `key` of an object, in their order, as text.

    A file is read up to every closing brace, in ranges. Strings are found by the quotes before, depth by the brackets
    outside of strings; an object of the list ends with a brace that returns to the list's depth.
    """
    stages = Stages(spark, "json-list")
    plain = F.regexp_replace("value", r"(?s)\\.", "")
    odd = F.pmod(F.regexp_count(plain, F.lit('"')), F.lit(2)) == 1
    text = lines(spark, path, "}").withColumns({"to0": odd, "to1": ~odd})
    text = entered(text, in_range())
    # The brace that ends a piece counts where it stands outside strings; the last piece of a file has none.
    deeper = {}
    for k in (0, 1):
        bare = _outside(F.when(F.col(f"in{k}"), F.concat(F.lit('"'), plain)).otherwise(plain))
        deeper[f"d{k}"] = _deeper(bare) - F.when(left(f"in{k}"), 0).otherwise(1)
    text = text.withColumns(deeper)
    sums = {f"s{k}": so_far(F.col(f"d{k}"), in_range()) for k in (0, 1)}
    held = stages.write(text.withColumns({**sums, "out0": left("in0"), "out1": left("in1")}), "pieces")
    names = [f"{c}{k}" for c in ("out", "s") for k in (0, 1)]
    ranges = held.groupBy("file", "start").agg(*[F.max_by(c, "id").alias(c) for c in names])
    ranges = entered(ranges.withColumnsRenamed({"out0": "to0", "out1": "to1"}), in_file())
    ranges = ranges.withColumn("depth", summed(F.when(F.col("in0"), F.col("s1")).otherwise(F.col("s0")), in_file()))
    ranges = stages.write(ranges.select("file", "start", F.col("in0").alias("inside_first"), "depth"), "entered")
    pick = lambda k: F.when(F.col("inside_first"), F.col(f"{k}1")).otherwise(F.col(f"{k}0"))
    known = of_ranges(held, ranges).select("file", "start", "id", "value", pick("in").alias("inside"), pick("out").alias("after"), (F.col("depth") + pick("s")).alias("below"), pick("d").alias("d"))
    known = known.withColumn("above", F.col("below") - F.col("d"))

    lists = stages.write(_lists(known, key), "lists")
    missing = known.select("file").distinct().join(lists.select("file"), "file", "left_anti")
    if not missing.isEmpty():
        raise Unreadable(f"{path} holds no list of objects")
    rows = known.join(small(lists.drop("last"), RANGE_BYTES), "file")
    place, begin = F.struct("start", "id"), F.col("begin")
    here = place == F.struct(begin["start"], begin["id"])
    rows = rows.where(place >= F.struct(begin["start"], begin["id"])).withColumn("value", F.when(here, F.substring(F.col("value"), F.col("offset") + 1, F.length("value"))).otherwise(F.col("value")))
    # At the list's depth a piece begins an object, or ends the list.
    leads = here | ((F.col("above") == F.col("level")) & ~F.col("inside"))
    rows = rows.withColumns({"leads": leads, "ends": (F.col("below") == F.col("level")) & ~F.col("after"), "over": leads & F.ltrim("value").rlike(r"^\s*\]")})
    rows = stages.write(rows.select("file", "start", "id", "value", "leads", "ends", "over"), "rows")
    over = rows.where("over").groupBy("file").agg(F.min(F.struct("start", "id")).alias("end"))
    over = stages.write(over, "over")
    if over.count() < lists.count():
        raise Unreadable(f"{path} ends inside its list")
    rows = rows.join(small(over, RANGE_BYTES), "file").where(place < F.col("end")).drop("over", "end")
    # The number of objects that end before a piece of its range, and before its range.
    ended = F.col("ends").cast("long")
    rows = stages.write(rows.withColumn("nth", so_far(ended, in_range()) - ended), "objects")
    counts = rows.groupBy("file", "start").agg(F.sum(ended).alias("n"))
    counts = stages.write(counts.select("file", "start", summed(F.col("n"), in_all()).alias("base")), "counts")
    parts = of_ranges(rows, counts).select((F.col("base") + F.col("nth")).alias("record"), "start", "id", F.concat("value", F.lit("}")).alias("value"), (F.col("leads") & F.col("ends")).alias("whole"))
    out = put_together(parts, "").withColumn("value", F.regexp_replace("value", r"^[\s,]+", ""))
    wrong = F.raise_error(F.concat(F.lit("not an object of a list: "), F.substring("value", 1, 60))).cast("string")
    out = out.withColumn("value", F.when(F.col("value").startswith("{"), F.col("value")).otherwise(wrong))
    stages.drop("pieces", "entered", "lists", "rows", "over")
    return out


def _lists(known: DataFrame, key: str) -> DataFrame:
    """(file, begin, offset, level, last): where each file's list begins: bare, or under the key of the outermost object."""
    first = known.groupBy("file").agg(F.min(F.struct("start", "id", "value")).alias("f"), F.max(F.struct("start", "id")).alias("last"))
    first = first.withColumn("head", F.regexp_replace("f.value", "^﻿", ""))
    bare = first.where(F.col("head").rlike(r"^\s*\[")).select(
        "file",
        F.struct("f.start", "f.id").alias("begin"),
        F.regexp_instr("f.value", F.lit(r"\[")).cast("int").alias("offset"),
        F.lit(1).cast("long").alias("level"),
        "last",
    )
    # Few pieces stand outside all lists of the outermost object; where the key's list begins in one is looked for by its tokens.
    held = first.where(F.col("head").rlike(r"^\s*\{")).select("file", "last")
    outer = known.where("above <= 1").join(held, "file").withColumn("offset", _key_list(key)("value", "above", "inside"))
    under = outer.where("offset > 0").groupBy("file").agg(F.min(F.struct("start", "id", "offset")).alias("b"), F.any_value("last").alias("last"))
    under = under.select("file", F.struct("b.start", "b.id").alias("begin"), F.col("b.offset").alias("offset"), F.lit(2).cast("long").alias("level"), "last")
    return bare.unionByName(under)


def _key_list(key: str):
    """Of a piece, its depth and whether it begins in a string: the place after the bracket of the key's list, or 0."""
    token, string_end = re.compile(r'"(?:[^"\\]|\\.)*"|[\[\]{}]', re.S), re.compile(r'(?:[^"\\]|\\.)*"', re.S)

    def place(value: str, depth: int, inside: bool) -> int:
        begun = string_end.match(value) if inside else None
        at, name = begun.end() if begun else len(value) * inside, None
        for m in token.finditer(value, at):
            t = m[0]
            if t[0] == '"':
                name = m if depth == 1 else name
            elif t in "[{":
                if t == "[" and depth == 1 and name and re.fullmatch(r"\s*:\s*", value[name.end() : m.start()]) and json.loads(name[0]) == key:
                    return m.end()
                depth += 1
            else:
                depth -= 1
        return 0

    @F.pandas_udf("int")
    def places(value: pd.Series, depth: pd.Series, inside: pd.Series) -> pd.Series:
        return pd.Series([place(*x) for x in zip(value, depth, inside, strict=True)], dtype="int32")

    return places
