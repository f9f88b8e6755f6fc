from pyspark.sql import functions as F

from quayside import catalogue
from quayside.operators import report, review
from quayside.plans.contract import catalog

SF = "/root/testdata/sf0.001"


def test_decisions(spark):
    names = "dataset string, source_field string, target string, status string, origin string"
    rows = [("d", c, t, "suggested", "names") for c, t in (("a", "contact.email"), ("b", None), ("c", "contact.phone"), ("d", "contact.role"), ("e", None), ("f", "contact.role"))]
    acts = [("d", "a", "approve", None), ("d", "b", "approve", "contact.phone"), ("d", "c", "edit", None), ("d", "d", "reject", None), ("d", "e", "approve", None), ("d", "f", "burn", None)]
    out = review.decide(spark.createDataFrame(rows, names), spark.createDataFrame(acts, "dataset string, source_field string, action string, target string"), catalog(spark))
    got = {r.source_field: (r.target, r.status, r.origin, r.refused) for r in out.collect()}
    assert got["a"] == ("contact.email", "approved", "names", False) and got["b"] == ("contact.phone", "approved", "manual", False)
    assert got["d"][1] == "rejected" and all(got[k][3] and got[k][1] == "suggested" for k in "cef")
    assert {r.status: r.n for r in review.status_counts(out).collect()} == {"approved": 2, "rejected": 1, "suggested": 3}


def test_fit(spark):
    rows = [("date", "text", 0, "incompatible"), ("date", "date", 0, "ok"), ("date", "date", 3, "transform"), ("date", "datetime", 0, "transform"), ("integer", "decimal", 0, "transform"), ("string", "empty", 0, "incompatible"), ("string", "text", 0, "ok"), ("list", "text", 0, "transform"), ("boolean", "integer", 0, "incompatible")]
    df = spark.createDataFrame(rows, "kind string, inferred string, changed int, want string")
    assert df.where(review.fit(F.col("kind"), F.col("inferred"), F.col("changed")) != F.col("want")).isEmpty()


def test_report(spark):
    q = catalogue.queries()
    text = report.render("Rehearsal", *(q[n](spark, SF) for n in ("g02_gates", "k05_coverage", "g03_work_items", "k02_checks", "g04_normalization_counts")))
    assert "Verdict: **BLOCKED**" in text and "| gate | state |" in text and text.count("## ") == 5
