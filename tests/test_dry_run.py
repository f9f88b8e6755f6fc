"""Rehearsals against a loop that writes one record after the other."""

import random

import pytest

from quayside.operators import write

SCHEMAS = {
    "organization": "id string, ord long, content_hash string, status string, fault boolean",
    "contact": "id string, ord long, content_hash string, organization_id string, is_primary boolean, email string, fault boolean",
    "subscription": "id string, ord long, content_hash string, organization_id string, status string, fault boolean",
}


def loop(records, limit, stop_after, threshold):
    store, primaries, mails, out = {e: {} for e in records}, set(), set(), {}
    in_a_row, stopped = 0, False
    for entity in ("organization", "contact", "subscription"):
        refused, ended = 0, False
        for n, r in enumerate(sorted(records[entity], key=lambda r: r["ord"])):
            key = (entity, r["ord"])
            if stopped or ended or (limit is not None and n >= limit):
                out[key] = ("not_attempted", None)
                continue
            if entity != "organization" and r["organization_id"] not in store["organization"]:
                out[key] = ("blocked", "parent_not_in_target")
                continue
            held, error = store[entity].get(r["id"]), None
            if r["fault"]:
                error = "target_unavailable"
            elif held:
                error = None if held["content_hash"] == r["content_hash"] else "duplicate_identifier"
            elif entity == "contact":
                mail = (r["organization_id"], r["email"].lower())
                if r["is_primary"] and r["organization_id"] in primaries:
                    error = "duplicate_primary_contact"
                elif mail in mails:
                    error = "duplicate_contact_email"
                else:
                    mails.add(mail)
                    primaries |= {r["organization_id"]} if r["is_primary"] else set()
            elif entity == "subscription" and store["organization"][r["organization_id"]]["status"] in ("inactive", "churned") and r["status"] in ("trial", "active"):
                error = "business_rule_violation"
            if error is None:
                out[key] = ("unchanged" if held else "created", None)
                store[entity].setdefault(r["id"], r)
            else:
                out[key] = ("failed" if r["fault"] else "rejected", error)
                refused += 1
            in_a_row = in_a_row + 1 if r["fault"] else 0
            stopped = in_a_row >= threshold
            ended = stop_after is not None and refused >= stop_after
    return out


@pytest.mark.parametrize("options", [(None, None, 10**6), (25, None, 10**6), (None, 12, 10**6), (30, 9, 3), (None, None, 2)])
def test_against_loop(spark, options):
    rnd = random.Random(sum(x or 0 for x in options))
    org = lambda: str(rnd.randrange(25))
    fault = lambda: rnd.random() < 0.2
    records = {
        "organization": [{"id": org(), "ord": i, "content_hash": rnd.choice("ab"), "status": rnd.choice(["active", "inactive", "churned"]), "fault": fault()} for i in range(40)],
        "contact": [{"id": str(rnd.randrange(60)), "ord": i, "content_hash": rnd.choice("ab"), "organization_id": org(), "is_primary": rnd.random() < 0.3, "email": rnd.choice(["A@x", "a@x", "b@x", "c@x"]), "fault": fault()} for i in range(80)],
        "subscription": [{"id": str(i), "ord": i, "content_hash": "a", "organization_id": org(), "status": rnd.choice(["trial", "active", "cancelled"]), "fault": fault()} for i in range(40)],
    }
    frames = {e: spark.createDataFrame([tuple(r[f.split()[0]] for f in SCHEMAS[e].split(", ")) for r in rows], SCHEMAS[e]).repartition(3) for e, rows in records.items()}
    got = {(r.entity, r.ord): (r.outcome, r.error_type) for r in write.dry_run(frames, *options).collect()}
    assert got == loop(records, *options)


def test_breaker_over_stretches(spark, monkeypatch):
    """Runs of failures go on from one stretch to the next, over stretches that hold nothing else."""
    monkeypatch.setattr(write, "STRETCH", 5)
    for outcomes in ("AFFFFFFFFFFFFFFFFFFA", "F" * 30, "A" * 30, "FFAFFFAFFFFAFFFFFAFFFFFFA", ""):
        rows = [("e", i, 0, "failed" if x == "F" else "accepted") for i, x in enumerate(outcomes)]
        df = spark.createDataFrame(rows, "entity string, ord long, entity_rank int, outcome string")
        run, want = 0, []
        for x in outcomes:
            run = run + 1 if x == "F" else 0
            want.append(run)
        trip = next((i for i, r in enumerate(want) if r >= 4), len(want))
        got = {r.ord: (r.run, r.not_attempted) for r in write.breaker(df, 4).collect()}
        assert got == {i: (r, i > trip) for i, r in enumerate(want)}


def test_no_more_stages_than_needed(spark, monkeypatch):
    """Each entity's answers are written once, and nothing is put into one order where failures are too few for a run."""
    names, own = [], write.barrier
    monkeypatch.setattr(write, "barrier", lambda df, name: names.append(name) or own(df, name))
    rows = [(str(i), i, "h", "active", i < 4) for i in range(9)]
    records = {"organization": spark.createDataFrame(rows, SCHEMAS["organization"])}
    few = {r.ord: r.outcome for r in write.dry_run(records, threshold=5).collect()}
    assert few == {i: "failed" if i < 4 else "created" for i in range(9)}
    assert not {"answers-organization", "stretches", "tried"} & set(names)
    enough = {r.ord: r.outcome for r in write.dry_run(records, threshold=4).collect()}
    assert enough == {i: "failed" if i < 4 else "not_attempted" for i in range(9)} and "stretches" in names
