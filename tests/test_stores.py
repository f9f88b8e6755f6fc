import json

import pytest
from pyspark.sql import functions as F

from quayside.operators import readiness
from quayside.operators.write import TargetStore
from quayside.plans import stores
from quayside.plans.stores import Conflict, Store


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_one_of_two_writers_wins(spark, tmp_path):
    store, other = Store(spark, str(tmp_path)), Store(spark, str(tmp_path))
    assert store.version().number == 0 and store.read(schema="id long").count() == 0
    with pytest.raises(LookupError):
        store.read()
    base, theirs = store.version().number, other.version().number
    assert store.replace(spark.range(5), base, ["id"], run="first").number == 1
    with pytest.raises(Conflict):
        other.replace(spark.range(50), theirs, ["id"])
    # The reader of before the other's data and the reader of after it see the first's rows alone.
    assert store.read().count() == other.read().count() == 5 and other.version().note == {"run": "first"}
    other.replace(spark.range(7), other.version().number, ["id"])
    assert store.read().count() == 7 and store.read(1).count() == 5 and store.versions() == [1, 2]
    store.vacuum()
    assert store.versions() == [2] and store.read().count() == 7 and len(list((tmp_path / "data").iterdir())) == 1


def test_a_version_is_there_when_it_is_named(spark, tmp_path):
    """Data without its version file, as of a writer that died, is not read."""
    store = Store(spark, str(tmp_path))
    store.replace(spark.range(3), 0, ["id"])
    (tmp_path / "versions" / "1.json").rename(tmp_path / "kept")
    assert store.version().number == 0
    store.replace(spark.range(4), 0, ["id"])
    assert store.read().count() == 4


def test_pages(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stores, "PART_ROWS", 40)
    df = spark.range(1000).select(F.col("id"), (F.col("id") * 37 % 1000).alias("key"), (F.col("id") % 7).alias("kind"), F.when(F.col("id") % 3 > 0, "x").alias("label"))
    store = Store(spark, str(tmp_path))
    store.replace(df, 0, ["key"], facets=("kind", "label"))
    whole = sorted((r.key, r.id, r.kind, r.label) for r in df.collect())
    for asked in ({}, {"kind": 3}, {"kind": 3, "label": "x"}, {"label": "none"}, {"kind": None}):
        own = [x for x in whole if all(v is None or dict(kind=x[2], label=x[3])[k] == v for k, v in asked.items())]
        for limit, offset in ((10, 0), (10, 35), (100, 90), (5, 990), (5, 5000)):
            page, total = store.page(limit, offset, **asked)
            assert total == len(own) and [(r.key, r.id, r.kind, r.label) for r in page.collect()] == own[offset : offset + limit]
    page, _ = store.page(10, 500)
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "part#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    with pytest.raises(ValueError):
        store.page(10, key=3)


def test_first_rows_are_kept(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stores, "PART_ROWS", 10)
    store = Store(spark, str(tmp_path))
    for limit, kept, cut in ((35, 35, True), (100, 100, False), (101, 100, False), (0, 0, True)):
        v = store.replace(spark.range(100), store.version().number, [-F.col("id")], limit=limit)
        assert (v.rows, v.truncated) == (kept, cut) and rows_of(store.read()) == [(i,) for i in range(100 - kept, 100)]
        assert store.page(1000)[1] == kept


def test_issues_of_a_run(spark, tmp_path):
    rows = [("contact", "d", i, f"c{i}", "email", "bad", ["info", "warning", "error"][i % 3], "m" * 3000) for i in range(30)]
    issues = spark.createDataFrame(rows, "entity string, dataset string, source_row long, record_id string, field string, error_type string, severity string, message string")
    store = Store(spark, str(tmp_path))
    v = readiness.store_issues(store, issues, 0, limit=15, run="r1")
    assert v.truncated and v.rows == 15 and v.note["run"] == "r1"
    assert {r.severity: r["count"] for r in store.read().groupBy("severity").count().collect()} == {"error": 10, "warning": 5}
    page, total = store.page(3, 1, severity="warning")
    assert total == 5 and [r.source_row for r in page.collect()] == [4, 7, 10] and len(page.first().message) == 2000


def test_target_store_has_one_writer_at_a_time(spark, tmp_path, monkeypatch):
    store = TargetStore(spark, str(tmp_path))
    drafts = spark.createDataFrame([("a", 1, ("x",)), ("b", 2, ("y",))], "record_id string, source_row long, payload struct<name:string>")
    store.write("organization", "n1", drafts)
    table = store.table("organization", "n1")
    base = table.version().number
    store.write("organization", "n1", drafts.withColumn("record_id", F.concat("record_id", F.lit("2"))))
    with pytest.raises(Conflict):
        table.append(store.read("organization", "n1").drop("namespace"), base)
    assert store.read("organization", "n1").count() == 4 and store.read("organization", "n2").count() == 0
    assert json.loads(store.read("organization", "n1").where("id = 'a'").first().payload) == {"name": "x"}
    assert store.purge("organization", "n1") == 4 and store.read("organization", "n1").count() == 0


def test_order_of_names_is_no_change(spark, tmp_path):
    """A payload whose fields come in another order, at any depth, is the one that is held."""
    store = TargetStore(spark, str(tmp_path))
    a = spark.createDataFrame([("a", 1, ("x", (1, [(2, "y")])))], "record_id string, source_row long, payload struct<name:string,more:struct<k:int,list:array<struct<n:int,t:string>>>>")
    b = spark.createDataFrame([("a", 1, (([("y", 2)], 1), "x"))], "record_id string, source_row long, payload struct<more:struct<list:array<struct<t:string,n:int>>,k:int>,name:string>")
    assert store.write("organization", "n", a).first().outcome == "created"
    assert store.write("organization", "n", b).first().outcome == "unchanged"
    assert store.write("organization", "n", b.withColumn("payload", F.col("payload").withField("name", F.lit("z")))).first().outcome == "conflict"
