"""Files that are read in ranges, against Python's own readers; ranges are so short that they fall anywhere."""

import csv
import io
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from quayside.sources import files, ranges


@pytest.fixture(params=[150, 1 << 20])
def cut(spark, request):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", request.param)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    yield request.param
    for k, v in kept.items():
        spark.conf.set(k, v)


def table(spark, path):
    df = files.read_csv(spark, str(path))
    names = [c for c in df.columns if c != "row_idx"]
    rows = sorted(df.collect(), key=lambda r: r.row_idx)
    assert [r.row_idx for r in rows] == list(range(len(rows)))
    return names, [[r[c] for c in names] for r in rows]


def expected(text):
    rows = [r for r in csv.reader(io.StringIO(text, newline="")) if r]
    return rows[0], [r + [""] * (len(rows[0]) - len(r)) for r in rows[1:]]


def test_csv(spark, tmp_path, cut):
    rnd = random.Random(4)
    cells = ["", "a", "plain text", "with, comma", 'a "quote"', "two\nlines", "three\n\n\nlines, \"and\" more\n", "0012", " blank ", "é€", '"', "\n", "x" * 90]
    for quoting in (csv.QUOTE_MINIMAL, csv.QUOTE_ALL):
        out = io.StringIO()
        w = csv.writer(out, quoting=quoting, lineterminator="\n")
        w.writerow(["id", "some text", "more"])
        for i in range(60):
            w.writerow([i, rnd.choice(cells), rnd.choice(cells)])
        path = tmp_path / f"q{quoting}.csv"
        path.write_text(out.getvalue(), newline="")
        assert table(spark, path) == expected(out.getvalue())


def test_csv_of_plain_lines_is_read_by_many_tasks(spark, tmp_path, cut):
    text = "a,b\r\n" + "".join(f'{i},"v, {i}"\r\n' for i in range(400))
    (tmp_path / "x.csv").write_text(text, newline="")
    assert table(spark, tmp_path / "x.csv") == expected(text)
    n = files.read_csv(spark, str(tmp_path / "x.csv")).select(F.spark_partition_id().alias("p")).distinct().count()
    assert n > 20 if cut == 150 else n <= 4


def test_csv_edges(spark, tmp_path):
    cases = {
        "bare quote": 'a,b\n5" pipe,x\n6" pipe,y\n',
        "blank lines": "a,b\n\n1,2\n   \n\n3,4\n",
        "short rows": "a,b,c\n1\n2,3\n4,5,6\n",
        "no end": "a,b\n1,2",
        "header of two lines": '"a\nb",c\n1,2\n',
        "no rows": "a,b\n",
        "only quotes": 'a,b\n"",""\n"""","x""y"\n',
    }
    for name, text in cases.items():
        path = tmp_path / f"{name}.csv"
        path.write_text(text, newline="")
        names, rows = expected(text)
        own = [r for r in rows if any(c.strip() for c in r) or len(r) > 1 and name != "blank lines"]
        assert table(spark, path) == (names, own), name
    (tmp_path / "open.csv").write_text('a,b\n1,"x\n2,y\n')
    with pytest.raises(ranges.Unreadable):
        table(spark, tmp_path / "open.csv")
    (tmp_path / "long.csv").write_text("a,b\n1,2,3\n")
    with pytest.raises(Exception, match="more cells than columns"):
        table(spark, tmp_path / "long.csv")


def test_csv_folder(spark, tmp_path, cut):
    for k in range(3):
        (tmp_path / f"part-{k}.csv").write_text("a,b\n" + "".join(f'{k},"{i}\n{i}"\n' if i % 5 == 0 else f"{k},{i}\n" for i in range(20)))
    names, rows = table(spark, tmp_path)
    assert names == ["a", "b"] and rows == [[str(k), f"{i}\n{i}" if i % 5 == 0 else str(i)] for k in range(3) for i in range(20)]


def records(spark, path):
    rows = sorted(ranges.json_records(spark, str(path)).collect())
    assert [r.record for r in rows] == list(range(len(rows)))
    return [json.loads(r.value) for r in rows]


def objects(n, seed):
    rnd = random.Random(seed)
    leaf = lambda: rnd.choice([1, 2.5, None, True, "x", 'a "b" \\ c', "}{][", "\\", "\n}", "é", "", [], {}, [1, {"k": "}"}], {"a": {"b": [{}]}}])
    return [{f"k{j}": leaf() for j in range(rnd.randrange(4))} for _ in range(n)]


def test_json(spark, tmp_path, cut):
    for seed, (indent, wrap) in enumerate([(None, None), (2, None), (None, {}), (1, {"page": 1, "data ": [{"data": 5}], "meta": {"data": [{"no": 1}], "s": '"data": [{'}, "nothing": []})]):
        rows = objects(40, seed)
        whole = rows if wrap is None else {**wrap, "data": rows, "has_more": False, "later": [{"x": 1}, {"y": []}]}
        path = tmp_path / f"{seed}.json"
        path.write_text(json.dumps(whole, indent=indent, ensure_ascii=False))
        assert records(spark, path) == rows


def test_json_edges(spark, tmp_path):
    for k, (text, want) in enumerate({"[]": [], ' [ {"a":1} ] ': [{"a": 1}], '{"data":[]}': [], '{"x":{"y":1},"data" : [ {"a":{}} ]}': [{"a": {}}], '[{}]\n': [{}], '[{},{}]': [{}, {}]}.items()):
        path = tmp_path / f"{k}.json"
        path.write_text(text)
        assert records(spark, path) == want, text
    for k, text in enumerate(['{"a":[{}]}', "5", '[{"a":1},', '[{"a":1}, 5, {"b":2}]', '{"data": 3}']):
        path = tmp_path / f"bad{k}.json"
        path.write_text(text)
        with pytest.raises(Exception, match="list"):
            records(spark, path)


def test_json_columns(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"data": [{"b": "x"}, {"a": 1, "b": null}, {"c": [1, {"d": 2, "b": [ ]}]}, {"c": "{\\"z\\":1, \\"a\\":2}"}]}')
    df = files.read_json(spark, str(tmp_path / "x.json"))
    assert df.columns == ["row_idx", "b", "a", "c"]
    assert sorted(tuple(r) for r in df.collect()) == [(0, "x", None, None), (1, None, "1", None), (2, None, None, '[1,{"b":[],"d":2}]'), (3, None, None, '{"z":1, "a":2}')]


def test_exports_of_many_tasks_are_one(spark, monkeypatch):
    """Exports that several tasks write, each its own file, read as one in the orders' order."""
    from quayside.catalogue import outcomes

    rows = spark.range(1000).selectExpr("id as o_orderkey", "cast(id as string) as id", "'a \"b\",\n}' as note", "cast(id as string) as customer").repartition(4)
    monkeypatch.setattr(outcomes, "_from", lambda *_: lambda *_: rows)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for kind, read in (("csv", files.read_csv), ("json", files.read_json)):
            path = outcomes._exported(spark, "", kind)
            assert len([x for x in os.listdir(path) if x.startswith("part-")]) > 1
            found = sorted((r.row_idx, r.id, r.note) for r in read(spark, path).collect())
            assert found == [(i, str(i), 'a "b",\n}') for i in range(1000)]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
