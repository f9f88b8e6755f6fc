"""From exports to a report: what validation lets through, the target accepts, and the numbers add up."""

from quayside.catalogue import records
from quayside.catalogue.views import view
from quayside.operators import rules
from quayside.plans.example_config import EXAMPLE
from quayside.project import Project

SF = "/root/testdata/sf0.001"


def rule_all(d):
    d["organization"] = rules.dormant_account_inactive(rules.ca_country_from_region(d["organization"], EXAMPLE), EXAMPLE)
    d["subscription"] = rules.drop_dead_trials(rules.legacy_gold_seat_split(d["subscription"], EXAMPLE), EXAMPLE)
    d["contact"], d["organization"] = rules.primary_from_account_email(d["contact"], d["organization"])
    return d


def test_whole_rehearsal(spark):
    exports = {source: view(spark, SF, source) for source, _, _ in records.DATASETS.values()}
    plans = {records.DATASETS[e][0]: records.plan_of(e) for e in records.DATASETS}
    project = Project(exports, plans, EXAMPLE, rules=[rule_all])
    assert project.profile("messy_contacts").count() == len(exports["messy_contacts"].columns) - 1
    valid = project.validate(project.drafts(), records.AS_OF)
    run = project.dry_run(valid)
    # Nothing that validation lets through breaks a rule of the target.
    assert {r.outcome for r in run.outcomes.select("outcome").distinct().collect()} == {"created"}
    held = run.records.where("outcome = 'accepted'").select("entity", "id")
    checks, off = project.reconcile(run, held)
    assert checks.count() == 28 and checks.where("not ok").isEmpty() and off.isEmpty()
    text = project.report("Rehearsal", valid, run, checks)
    assert "Verdict: **" in text and "reconciliation | PASS" in text
    # An outage stops the run, and a record that the target lost is found.
    down = project.dry_run({"organization": valid["organization"]}, fault=valid["organization"]["source_row"] > 0, threshold=3)
    n = {r.outcome: r["count"] for r in down.outcomes.groupBy("outcome").count().collect()}
    assert n["failed"] == 3 and n["not_attempted"] == down.outcomes.count() - 3
    lost = held.orderBy("entity", "id").limit(1)
    _, off = project.reconcile(run, held.join(lost, ["entity", "id"], "left_anti"))
    assert [(r.entity, r.kind, r["count"], r.sample_ids) for r in off.collect()] == [(lost.first().entity, "missing_in_target", 1, lost.first().id)]
