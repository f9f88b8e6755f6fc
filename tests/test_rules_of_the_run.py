"""Several exports of one entity, gates at their edges, limits of none and fields without a proposal."""

from quayside.operators import evaluation, readiness, rules, validate, write
from quayside.plans.drafts import build_plan, compile_drafts, emissions
from quayside.plans.example_config import EXAMPLE


def drafts(spark, entity, columns, *exports):
    """Drafts of exports (name, rows) in the order of their plans; the first column is row_idx."""
    out = None
    for rank, (name, rows) in enumerate(exports):
        plan = build_plan(name, [(c.split(".")[1], c, "approved") for c in columns])
        df = spark.createDataFrame(rows, "row_idx long, " + ", ".join(f"{c.split('.')[1]} string" for c in columns))
        own = compile_drafts(df, plan, entity, EXAMPLE, rank=rank)
        out = own if out is None else out.unionByName(own)
    return out


def test_the_first_export_comes_first(spark):
    """Of one id, the draft of the earlier plan stands, whatever its row and the export's name."""
    both = drafts(spark, "organization", ["organization.organization_id"], ("z.csv", [(5, "A1"), (6, "A2")]), ("a.csv", [(1, "A1"), (6, "A3")]))
    found = {(r.dataset, r.source_row): [(i.error_type, i.message) for i in r.issues] for r in validate.check_unique_ids(both, "organization").collect()}
    assert found[("z.csv", 5)] == [] and found[("a.csv", 6)] == []
    assert [k for k, _ in found[("a.csv", 1)]] == ["duplicate_identifier"] and "z.csv row 5" in found[("a.csv", 1)][0][1]


def test_the_last_status_stated_counts(spark):
    """Of two drafts of an id, the later one without a status: the earlier one's still refuses a live subscription."""
    orgs = drafts(spark, "organization", ["organization.organization_id", "organization.lifecycle_status"], ("o.csv", [(1, "A1", "Closed"), (2, "A1", "")]))
    subs = drafts(spark, "subscription", ["subscription.subscription_id", "subscription.organization_id", "subscription.status"], ("s.csv", [(1, "S1", "A1", "active")]))
    state = validate.organization_state(orgs)
    assert [r.status for r in state.collect()] == ["churned"]
    assert [[i.error_type for i in r.issues] for r in validate.check_lifecycle(subs, state).collect()] == [["business_rule_violation"]]


def test_rules_over_two_exports_keep_the_number_of_drafts(spark):
    """Organizations of two exports at the same row: each has its own warning, none is there twice."""
    orgs = drafts(spark, "organization", ["organization.organization_id", "contact.email"], ("a.csv", [(1, "A1", "x@example.com")]), ("b.csv", [(1, "B1", "y@example.com")]))
    people = drafts(spark, "contact", ["contact.contact_id", "contact.organization_id", "contact.email", "contact.is_primary"], ("p.csv", [(1, "C1", "B1", "z@example.com", "N")]), ("q.csv", [(1, "C2", "A1", "x@example.com", "N")]))
    contacts, organizations = rules.primary_from_account_email(people, orgs)
    assert organizations.count() == 2 and contacts.count() == 2
    assert {(r.dataset, tuple(i.error_type for i in r.issues)) for r in organizations.collect()} == {("a.csv", ()), ("b.csv", ("primary_contact_not_found",))}
    assert {(r.record_id, r.payload.is_primary) for r in contacts.collect()} == {("C1", "false"), ("C2", "true")}


def test_gates_at_their_edges(spark):
    """One record in a million that stays behind is a condition; just under the floor blocks; without checks nothing is reconciled."""
    covered = spark.createDataFrame([("contact", 1_000_000, 999_960), ("activity", 100_000, 94_996), ("organization", 0, 0), ("subscription", 20, 19)], "entity string, in_scope long, accepted long")
    checks = spark.createDataFrame([("contact", "target_ids", True)], "entity string, check string, ok boolean")
    found = {r.gate: r.state for r in readiness.gates(covered, checks, 0).collect()}
    assert found == {"coverage:contact": "CONDITION", "coverage:activity": "BLOCKER", "coverage:organization": "PASS", "coverage:subscription": "CONDITION", "reconciliation": "PASS", "warnings": "PASS", "verdict": "BLOCKED"}
    assert {r.gate: r.state for r in readiness.gates(covered, checks.where("false"), 3).collect()}["reconciliation"] == "BLOCKER"


def test_a_limit_of_none(spark):
    rows = spark.createDataFrame([("contact", i, "accepted") for i in range(5)], "entity string, ord long, outcome string")
    assert [write.limit_per_entity(rows, n).where("not_attempted").count() for n in (0, 2, 5)] == [5, 3, 0]


def test_judge_and_metrics(spark):
    fields = [("a", "t1", [], False, False), ("b", None, [], False, False), ("c", "t1", ["t2"], True, False), ("d", "t1", [], False, True), ("e", "t1", ["t2"], False, False), ("f", "t1", [], False, False), ("g", None, [], True, False)]
    golden = spark.createDataFrame([("d", *f) for f in fields], "dataset string, source_field string, expected string, accept array<string>, clarify boolean, clarify_ok boolean")
    offers = [("c", "t2", False, 0.95), ("d", None, True, 0.2), ("e", "t3", False, 0.9), ("f", None, True, None)]
    proposals = spark.createDataFrame([("d", *o) for o in offers], "dataset string, source_field string, target string, asks boolean, confidence double")
    rows = evaluation.judge(golden, proposals)
    assert {r.source_field: r.outcome for r in rows.collect()} == {"a": "unresolved", "b": "unresolved", "c": "overconfident", "d": "correct", "e": "wrong", "f": "deferred", "g": "unresolved"}
    m = evaluation.metrics(rows).first()
    assert (m.fields, m.correct, m.accuracy, m.target_fields, m.target_accuracy) == (7, 1, 0.143, 5, 0.2)
    assert (m.clarify_expected, m.clarify_flagged, m.clarification_recall, m.clarification_false_positives) == (2, 0, 0.0, 1)
    assert (m.incorrect_high_confidence, m.mean_confidence_correct, m.mean_confidence_incorrect, m.transformation_flag_recall) == (2, 0.2, 0.925, None)


def test_emissions(spark):
    rows = [("a", "organization.organization_id", "approved"), ("a", "contact.email", "approved"), ("a", "contact.contact_id", "rejected"), ("b", "contact.contact_id", "approved"), ("b", None, "approved")]
    df = spark.createDataFrame(rows, "dataset string, target string, status string")
    assert sorted(tuple(r) for r in emissions(df).collect()) == [("a", "organization"), ("b", "contact")]
