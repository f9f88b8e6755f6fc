"""Small vectors: cells, converters, plans, names, writes and sources."""

import io
import json
import urllib.error
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quayside.catalogue import profiling
from quayside.functions import cells, texts
from quayside.functions.converters import Context, apply_chain
from quayside.operators import compare, evaluation, readiness, reconcile, write
from quayside.operators.profile import check_reference, column_facts, infer_references, quality_issues, references, value_table, value_tables
from quayside.plans.config import ValueMap, config_from
from quayside.plans.contract import catalog
from quayside.plans.drafts import UndecidedFields, build_plan
from quayside.plans.example_config import EXAMPLE
from quayside.sources import files, paged
from quayside.sources.synthetic import exports, organizations


def column(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_tags(spark):
    pairs = [
        (None, "blank"), ("", "blank"), ("  ", "blank"), ("N/A", "placeholder"), ("-", "placeholder"), ("nil", "placeholder"), ("12", "integer"), ("-3", "integer"), ("1.5", "decimal"), (".5", "decimal"),
        ("$7,050,000", "numeric_text"), ("38.60M", "numeric_text"), ("USD 60", "numeric_text"), ("12%", "numeric_text"), ("a@b.co", "email"), ("a@b", "email_malformed"), ("x at y.com", "email_malformed"),
        ("https://a.b", "url"), ("www.a.com", "url_no_scheme"), ("CT-000102", "identifier"), ("2024-01-31", "date"), ("01/31/2024", "date"), ("31-Jan-2024", "date"), ("January 5, 2024", "date"),
        ("2024-01-31T10:00:00Z", "datetime"), ("2024-01-31 10:00", "datetime"), ("(699) 445-0012", "phone"), ("757-2046", "phone_short"), ("NAICS", "code"), ("plain words", "text"), ("26th of August", "text"),
    ]
    assert column(spark, [v for v, _ in pairs], cells.tag) == [t for _, t in pairs]


def test_numbers_shapes_dates(spark):
    assert column(spark, ["$7,050,000", "38.60M", "2B", "1,475.00", "12%", "x"], cells.parse_number) == [7050000.0, 38600000.0, 2e9, 1475.0, 12.0, None]
    assert column(spark, ["CT-000102", "Jane Smith", "é9", "a" * 30], cells.shape) == ["AA-999999", "Aaaa Aaaaa", "a9", "a" * 24 + "…"]
    assert [str(x)[:10] if x else None for x in column(spark, ["3/4/85", "3/4/12", "2/30/2020"], lambda v: cells.first_format(v, cells.DATE_FORMATS)[0])] == ["1985-03-04", "2012-03-04", None]


def test_values_are_trimmed_once(spark):
    """A value is one row whatever white space is around it, and facts of columns without rows, or of none that say anything, are whole."""
    df = spark.createDataFrame([(1, " a", None), (2, "a", "7"), (3, "a\u00a0", "-"), (4, "b  c", " 7.5"), (5, " ", "$7"), (6, None, "n/a ")], "row_idx int, x string, y string")
    got = {(r.col, r.pos, r.v): (r.tag, r.n, r.first, r.stray) for r in value_table(df).collect()}
    assert got == {
        ("x", 0, "a"): ("text", 3, 1, 2), ("x", 0, "b  c"): ("text", 1, 4, 1), ("x", 0, ""): ("blank", 1, 5, 1), ("x", 0, None): ("blank", 1, 6, 0), ("y", 1, None): ("blank", 1, 1, 0),
        ("y", 1, "7"): ("integer", 1, 2, 0), ("y", 1, "-"): ("placeholder", 1, 3, 0), ("y", 1, "7.5"): ("decimal", 1, 4, 1), ("y", 1, "$7"): ("numeric_text", 1, 5, 0), ("y", 1, "n/a"): ("placeholder", 1, 6, 1),
    }
    facts = column_facts(value_tables({"t": df, "none": df.limit(0)}))
    got = {(r.src, r.col): (r.pos, r.n_rows, r.non_null, r.blank, r.placeholder, r.whitespace, r.distinct_count, r.min, r.max, r.numbers, r.bad_number, r.inferred_type) for r in facts.collect()}
    assert got == {("t", "x"): (0, 6, 4, 2, 0, 3, 2, None, None, 0, 4, "text"), ("t", "y"): (1, 6, 3, 1, 2, 1, 3, 7.0, 7.5, 3, 0, "decimal")}


def test_types_are_found_without_writing_the_values(spark, monkeypatch):
    monkeypatch.setattr(profiling, "barrier", lambda df, name: pytest.fail("the values were written"))
    for name in ("p17_key_facts", "p18_type_decision"):
        assert profiling.Q[name](spark, "/root/testdata/sf0.001").columns[:2] == ["src", "col"]


def test_stripping_is_that_of_all_white_space(spark):
    texts = [f"{a}x{b}y{a}" for a in map(chr, [*range(1, 0x30), 0x7F, 0x80, 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF, 0x1F600]) for b in (" ", "")] + ["", " ", "\t\n ", None, " \u3000é ", "a\n", "\r\na"]
    want = column(spark, texts, lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    assert column(spark, texts, cells.strip) == want and column(spark, texts, cells.strip_plain) == want


def test_numbers_by_tag(spark):
    texts = ["12", "-3", "1.5", ".5", "$7,050,000", "38.60M", "USD 60", "ABC123", "12%", "2B", "x", "a@1", "https://1", "2024-01-31", "-", "", "1 2", "+1 415 555 2671", None]
    assert column(spark, texts, lambda v: cells.tagged_number(v, cells.tag(v))) == column(spark, texts, cells.parse_number)


def test_converters(spark):
    ctx = Context("t", date_formats=EXAMPLE.date_formats, datetime_formats=EXAMPLE.datetime_formats, placeholders=EXAMPLE.placeholders)
    value = lambda name, vs: column(spark, vs, lambda v: apply_chain(v, [name], ctx).value)
    kind = lambda name, vs: column(spark, vs, lambda v: apply_chain(v, [name], ctx).error_type)
    assert value("money", ["$1,475.005", "12.35M", "5k", "CAD 10", "1e3", "-1", "€5", ""]) == ["1475.00", "12350000.00", "5000.00", "10.00", "1000.00", None, None, None]
    assert kind("money", ["-1", "€5", "", "NaN"]) == ["out_of_range", "unparseable_number", None, "unparseable_number"]
    assert value("integer", ["1200.0", " 1,200 ", "1200.7"]) == ["1200", "1200", None]
    assert value("person_name_split", ["COLLINS, JILLIAN", "Mrs. Dana Munoz MD", "Cher", "Jane Smith, MD", "o'neil mc-donald"]) == ["Jillian\tCollins", "Dana\tMunoz", None, None, "O'Neil\tMc-Donald"]
    assert value("datetime", ["2024-01-15T10:00:00Z", "2024-01-15 10:00:00-05:00", "01/15/2024 10:00"]) == ["2024-01-15T10:00:00Z", "2024-01-15T15:00:00Z", "2024-01-15T10:00:00Z"]
    assert value("phone_e164", ["(699) 445-0012", "1 415 555 2671", "+44 20 7946 0958", "757-2046"]) == ["+16994450012", "+14155552671", "+442079460958", None]
    assert value("title_case", ["ANN LEE", "McDonald", "ann"]) == ["Ann Lee", "McDonald", "Ann"]
    assert value("string_list", ["a; B,b|c ;", " ; "]) == ["a|B|c", None]
    with pytest.raises(KeyError):
        apply_chain(F.lit("x"), ["nothing"], ctx)


def test_config_is_closed():
    with pytest.raises(ValueError):
        config_from({"as_of": "2024-01-01", "extra": 1})
    with pytest.raises(ValueError):
        config_from({"as_of": "2024-01-01", "overrides": {"contact.phone": ["nothing"]}})
    with pytest.raises(ValueError):
        ValueMap({"yes": True})
    assert config_from({"as_of": "2024-01-01", "value_maps": {"contact.role": {"map": {"ap": "billing"}, "unmapped": "default"}}}).context("contact.role").unmapped == "default"
    with pytest.raises(UndecidedFields):
        build_plan("d", [("a", "contact.email", "proposed")])
    assert build_plan("d", [("a", "contact.email", "approved"), ("b", None, "ignored")]).emits() == ()


def test_names(spark):
    names = ["acct_num", "contactMail", "companies", "bus_status", ""]
    assert column(spark, names, compare.words) == [["organization", "number"], ["contact", "email"], ["organization"], ["bus", "status"], []]
    assert column(spark, ["activity.csv", "misc.csv", "customer.people.v2"], compare.entity_of) == ["activity", None, "organization"]
    df = spark.createDataFrame([(["email"], ["email"]), (["name"], ["first", "name"]), ([], ["a"])], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(compare.name_score(F.col("a"), F.col("b"))).collect()] == [1.0, 0.5, 0.0]


def test_classes_of_fields(spark):
    """A strong name in two entities is no match where the entity is unknown; values decide the rest."""
    names = [("contacts.csv", "email"), ("contacts.csv", "phone"), ("misc.csv", "status"), ("misc.csv", "email"), ("organizations.csv", "industry"), ("organizations.csv", "zzz"), ("organizations.csv", "customer_since")]
    fields = spark.createDataFrame(names, "dataset string, source_field string")
    given = {
        ("contacts.csv", "email"): {"inferred_type": "email"}, ("contacts.csv", "phone"): {"inferred_type": "phone", "e164": 3, "non_null": 5}, ("misc.csv", "email"): {"inferred_type": "text"},
        ("organizations.csv", "industry"): {"inferred_type": "category", "value_counts": {"Energy ": 3, "energy": 1}}, ("organizations.csv", "customer_since"): {"inferred_type": "date", "date_formats": 2, "iso_pct": 50.0},
    }
    schema = T._parse_datatype_string(f"dataset string, source_field string, {compare.FACTS}")
    facts = spark.createDataFrame([tuple({"dataset": k[0], "source_field": k[1], **v}.get(f.name) for f in schema) for k, v in given.items()], schema)
    found = compare.judged(compare.candidates(fields, catalog(spark)), facts, catalog(spark))
    got = {(r[0], r[1]): (r[2], r[3]) for r in compare.classify(found, fields).collect()}
    assert got == {
        ("contacts.csv", "email"): ("matched", "contact.email"), ("contacts.csv", "phone"): ("transformation_required", "contact.phone"), ("misc.csv", "status"): ("ambiguous", None), ("misc.csv", "email"): ("incompatible", "contact.email"),
        ("organizations.csv", "industry"): ("transformation_required", "organization.industry"), ("organizations.csv", "zzz"): ("unmapped", None), ("organizations.csv", "customer_since"): ("transformation_required", "organization.customer_since"),
    }
    notes = {r.source_field: r.notes for r in found.where("place = 1").collect()}
    assert notes["phone"] == ["not E.164"] and notes["industry"] == ["other spellings"] and notes["customer_since"] == ["date formats: 2"]


def test_store_is_idempotent(spark, tmp_path):
    store = write.TargetStore(spark, str(tmp_path))
    drafts = spark.createDataFrame([("a", 1, ("x",)), ("b", 2, (None,)), ("a", 3, ("x",)), ("a", 4, ("y",))], "record_id string, source_row long, payload struct<name:string>")
    first = {(r.id, r.ord): r.outcome for r in store.write("organization", "n1", drafts).collect()}
    assert first == {("a", 1): "created", ("b", 2): "created", ("a", 3): "unchanged", ("a", 4): "conflict"}
    assert {r.outcome for r in store.write("organization", "n1", drafts.where("source_row < 3")).collect()} == {"unchanged"}
    assert store.read("organization", "n2").count() == 0
    assert store.purge("organization", "n1") == 2 and store.read("organization", "n1").count() == 0
    with pytest.raises(ValueError):
        store.purge("organization", write.LIVE_NAMESPACE)


def test_balanced_run_is_ready(spark):
    rows = spark.createDataFrame([("organization", "a", False, None, "accepted"), ("organization", "b", True, None, None)], "entity string, id string, skipped boolean, first_error string, outcome string")
    held = rows.where("outcome = 'accepted'")
    ledger = reconcile.ledger(rows)
    found = reconcile.checks(ledger, held, reconcile.id_difference(held, held, rows.where("false")))
    assert found.count() == 7 and found.where("not ok").isEmpty()
    assert {r.gate: r.state for r in readiness.gates(reconcile.coverage(ledger), found, 0).collect()}["verdict"] == "READY"


def test_synthetic_defects_are_found(spark):
    df, manifest = organizations(spark, 1000, seed=5)
    assert df.where("acct_num = ''").count() == manifest["missing_id"]
    assert df.exceptAll(organizations(spark, 1000, seed=5)[0]).isEmpty()
    found = {(r.column, r.code): r["count"] for r in quality_issues(df, "2024-01-01").collect()}
    assert found[("website", "placeholder_values")] == manifest["placeholder_site"] and found[("acct_num", "key_missing")] == manifest["missing_id"]


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,name\n01,"x, ""y"""\n,\n')
    rows = files.read(spark, "csv", "a.csv", str(tmp_path)).orderBy("row_idx").collect()
    assert [(r.id, r.name, r.row_idx) for r in rows] == [("01", 'x, "y"', 0), ("", "", 1)]
    (tmp_path / "b.json").write_text(json.dumps({"data": [{"a": 1.0, "b": "x"}, {"c": None, "a": 2}]}))
    df = files.read(spark, "json", "b.json", str(tmp_path))
    assert df.columns == ["row_idx", "a", "b", "c"]
    assert [(r.a, r.b, r.c) for r in df.orderBy("row_idx").collect()] == [("1.0", "x", None), ("2", None, None)]
    for bad in ("/etc/passwd", "../x"):
        with pytest.raises(files.SourceUnavailable):
            files.read(spark, "csv", bad, str(tmp_path))


def test_paged_feed():
    answers = iter([urllib.error.HTTPError("u", 429, "slow", {"Retry-After": "3"}, io.BytesIO()), {"data": [{"a": 1}, {"a": 2}], "has_more": True}, urllib.error.URLError("down"), {"data": [{"a": 3}]}])
    waits = []

    def get(url, token):
        answer = next(answers)
        if isinstance(answer, Exception):
            raise answer
        return answer

    assert list(paged.read_pages("u", None, 2, get=get, sleep=waits.append)) == [(0, {"a": 1}), (1, {"a": 2}), (2, {"a": 3})]
    assert waits == [3.0, 0.5]
    now = datetime(2024, 1, 1, tzinfo=UTC)
    assert paged.retry_after("Mon, 01 Jan 2024 00:00:10 GMT", now) == 10.0 and paged.retry_after("Sun, 31 Dec 2023 00:00:00 GMT", now) == 0.0 and paged.retry_after("soon") is None


def test_references_between_all_tables(spark):
    """Every pair from one index: a key in two parents, a table with its own key of that name, blanks, ties and no values."""
    frames = {
        "orgs": spark.createDataFrame([(i, f"A{i}") for i in range(40)], "row_idx long, acct string"),
        "more": spark.createDataFrame([(i, f"A{i + 30}") for i in range(40)], "row_idx long, acct string"),
        "contacts": spark.createDataFrame([(0, "c0", " A1 "), (1, "c1", "Z9"), (2, "c2", None), (3, "c3", "n/a"), (4, "c4", "Z9"), (5, "c5", "Y1"), (6, "c6", "A35"), (7, "c7", "A60")], "row_idx long, contact string, acct string"),
        "notes": spark.createDataFrame([(0, None, "c1"), (1, "", "c9")], "row_idx long, acct string, contact string"),
    }
    keys = {"orgs": "acct", "more": "acct", "contacts": "contact"}
    got = {(r.child, r.references): (r.checked, r.resolved, r.orphans, r.orphan_pct, r.examples) for r in references(frames, keys).collect()}
    assert got == {
        ("contacts", "orgs.acct"): (6, 2, 4, 66.7, "Z9, Y1, A60"),
        ("contacts", "more.acct"): (6, 2, 4, 66.7, "A1, Z9, Y1"),
        ("notes", "orgs.acct"): (0, 0, 0, 0.0, ""),
        ("notes", "more.acct"): (0, 0, 0, 0.0, ""),
        ("notes", "contacts.contact"): (2, 1, 1, 50.0, "c9"),
    }
    rows = {n: spark.createDataFrame([(i, f"{p}-{1000 + i}", f"A-{2000 + i % 9}") for i in range(30)], f"row_idx long, {n}_id string, acct_id string") for n, p in (("ticket", "T"), ("call", "C"))}
    rows["accounts"] = spark.createDataFrame([(i, f"A-{2000 + i}", f"name {i}") for i in range(8)], "row_idx long, acct_id string, name string")
    found = {(r.child, r.references): (r.checked, r.orphans, r.examples) for r in infer_references(rows).collect()}
    assert found == {("ticket", "accounts.acct_id"): (30, 3, "A-2008"), ("call", "accounts.acct_id"): (30, 3, "A-2008")}


def test_texts_and_opaque_names(spark):
    df = spark.createDataFrame([(1234567, 1, 8, "2026-10-02T07:38:31+00:00", [("a", 1), ("b", 2000), ("c", 3), ("d", 4), ("e", 5)], "1,200 of 7. and 3.5")], "n long, part long, whole long, at string, v array<struct<v:string,n:long>>, t string")
    r = df.select(texts.thousands(F.col("n")), texts.share(F.col("part"), F.col("whole")), texts.share(F.col("part"), F.lit(0)), texts.moment(F.col("at")), texts.counted_values(F.col("v")), texts.numbers_in(F.col("t"))).first()
    assert list(r) == ["1,234,567", "12.5%", "n/a", "2026-10-02 07:38 UTC", "'a' (1), 'b' (2,000), 'c' (3), 'd' (4) and 1 more", ["1200", "7", "3.5"]]
    a, b = spark.createDataFrame([(1, 2)], "key int, x int"), spark.createDataFrame([(1, 2)], "y int, key int")
    out, codes = evaluation.opaque({"a": a, "b": b})
    assert codes == {"key": "c01", "x": "c02", "y": "c03"} and out["a"].columns == ["c01", "c02"] and out["b"].columns == ["c03", "c01"]


def test_listing_and_missing_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id\n1\n")
    (tmp_path / "b.txt").write_text("x")
    assert [(r.location, r.kind) for r in files.listing(spark, str(tmp_path)).collect()] == [("a.csv", "csv")]
    with pytest.raises(files.SourceUnavailable):
        files.read(spark, "csv", "none.csv", str(tmp_path))


def test_related_exports(spark):
    """What the manifest says is planted is what profiles and references find."""
    out, manifest = exports(spark, 300, seed=4)
    assert {k: df.count() for k, df in out.items()} == {"organizations": 300, "contacts": 600, "subscriptions": 300, "activities": 1200}
    parents = spark.range(300).select((F.col("id") + 10000).cast("string").alias("acct_num"))
    for name in ("contacts", "subscriptions", "activities"):
        found = check_reference(out[name], parents, "acct_num").first()
        assert found.orphans == manifest[name]["orphan"] and found.checked == out[name].count()
    issues = {(r.column, r.code): r["count"] for r in quality_issues(out["contacts"], "2024-12-31").collect()}
    assert issues[("contact_mail", "malformed_email")] == manifest["contacts"]["malformed_mail"] and issues[("phone_number", "malformed_phone")] == manifest["contacts"]["short_phone"]
    issues = {(r.column, r.code): r["count"] for r in quality_issues(out["activities"], "2024-12-31").collect()}
    assert issues[("occurred_at", "future_dates")] == manifest["activities"]["future"]
