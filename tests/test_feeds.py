"""A feed whose length nobody knows, and a target that answers as it likes, on a local server."""

import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

from quayside.sources import files, paged
from quayside.sources.target import Sender, held_ids, outcomes, send


@pytest.fixture
def serve():
    """Serves answer(handler, path, query, body) -> (status, headers, body); gives the address."""
    servers = []

    def start(answer):
        class Handler(BaseHTTPRequestHandler):
            def _do(self):
                at = urlparse(self.path)
                body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
                status, headers, out = answer(self, at.path, {k: v[0] for k, v in parse_qs(at.query).items()}, body)
                out = out if isinstance(out, bytes) else json.dumps(out).encode()
                self.send_response(status)
                for k, v in {**headers, "Content-Length": str(len(out))}.items():
                    self.send_header(k, v)
                self.end_headers()
                self.wfile.write(out)

            do_GET = do_POST = do_DELETE = _do

            def log_message(self, *args):
                pass

        server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=server.serve_forever, daemon=True).start()
        servers.append(server)
        return f"http://127.0.0.1:{server.server_address[1]}"

    yield start
    for s in servers:
        s.shutdown()


def feed(rows, asked, says=True, fail=lambda page, n: None):
    lock = threading.Lock()

    def answer(handler, path, query, body):
        page, size = int(query["page"]), int(query["page_size"])
        with lock:
            asked[page] += 1
            n = asked[page]
        if bad := fail(page, n):
            return bad
        own = rows[(page - 1) * size : page * size]
        return 200, {}, {"data": own, **({"has_more": page * size < len(rows)} if says else {})}

    return answer


@pytest.mark.parametrize("n, says", [(0, True), (1, True), (160, True), (163, True), (163, False), (160, False)])
def test_feed_of_unknown_length(spark, serve, n, says):
    rows, asked = [{"id": i, "name": f"n{i}", "tags": [i]} for i in range(n)], Counter()
    url = serve(feed(rows, asked, says, lambda page, k: (429, {"Retry-After": "0"}, {}) if page == 3 and k == 1 else None))
    df = files.read(spark, "api", url, "", page_size=4, pages_per_task=3)
    assert [tuple(r) for r in df.orderBy("row_idx").collect()] == [(i, str(i), f"n{i}", f"[{i}]") for i in range(n)]
    if n > 100:
        assert df.columns == ["row_idx", "id", "name", "tags"]
        # Each page once, and about twice the logarithm of their number to find the last.
        assert sum(asked.values()) <= 41 + 14 + 2


def test_pages_are_many_tasks(serve):
    rows, asked = [{"id": i} for i in range(1000)], Counter()
    reader = paged.PagedReader(type("S", (), {"fields": []})(), {"url": serve(feed(rows, asked)), "page_size": "1"})
    parts = reader.partitions()
    assert len(parts) == 63 and sum(asked.values()) <= 24 and parts[-1].last is None


def test_stop_rule(serve):
    """What ends before the end is read to the first end in one task, and is an error where tasks read beyond it."""
    early = lambda handler, path, query, body: (200, {}, {"data": [{"id": query["page"]}], "has_more": query["page"] not in ("3", "8")})
    f = paged.Feed(serve(early), None, 1)
    assert [r["id"] for _, r in f.records()] == ["1", "2", "3"]
    with pytest.raises(paged.UnsteadyFeed):
        list(f.records(1, 4, True))
    endless = paged.Feed(serve(lambda *a: (200, {}, {"data": [{"id": 1}], "has_more": True})), None, 1)
    with pytest.raises(paged.EndlessFeed):
        endless.last_page()


class Target:
    """Holds records by id; each answer may be spoiled by a rule of (id, times asked)."""

    def __init__(self, spoil=lambda i, n: None):
        self.held, self.asked, self.spoil, self.lock, self.headers = {}, Counter(), spoil, threading.Lock(), []

    def __call__(self, handler, path, query, body):
        with self.lock:
            if handler.command == "GET":
                at, n = int(query["offset"]), int(query["limit"])
                return 200, {}, [{"organization_id": i} for i in sorted(self.held)[at : at + n]]
            record = json.loads(body)
            i = record["organization_id"]
            self.asked[i] += 1
            self.headers.append(dict(handler.headers))
            bad = self.spoil(i, self.asked[i])
            if bad and bad[0] != "lands":
                return bad
            there = self.held.get(i)
            if there is not None and there != record:
                return 409, {}, {"error": {"type": "duplicate_identifier", "message": "already there"}}
            self.held[i] = record
            return (500, {}, b"lost") if bad else (201 if there is None else 200, {}, {"created": there is None})


def payloads(spark, rows):
    return spark.createDataFrame([(i, json.dumps({"organization_id": i, "name": n})) for i, n in rows], "id string, payload string")


def test_send_and_read_back(spark, serve, tmp_path):
    rows = [(f"o{i:03d}", f"n{i}") for i in range(200)]
    spoiled = {"o001": lambda n: (429, {"Retry-After": "0"}, {}) if n < 3 else None, "o002": lambda n: (500, {}, {"error": {"type": "target_unavailable"}}), "o003": lambda n: (422, {}, {"error": {"type": "missing_required", "message": "no"}}), "o004": lambda n: (200, {}, b"what") if n == 1 else None, "o005": lambda n: ("lands",) if n == 1 else None, "o006": lambda n: (418, {}, b"teapot")}
    target = Target(lambda i, n: spoiled.get(i, lambda n: None)(n))
    url = serve(target)
    out = send(payloads(spark, rows).repartition(5), url=f"{url}/organizations", folder=str(tmp_path / "run"), token="t", namespace="n1", prefix="r", attempts=3, step=0)
    got = {r.id: r for r in out.collect()}
    assert got.keys() == {i for i, _ in rows} and out.count() == 200
    said = {i: (got[i].outcome, got[i].created, got[i].attempts, got[i].status, got[i].error_type) for i in [*spoiled, "o100"]}
    assert said == {"o001": ("accepted", True, 3, 201, None), "o002": ("failed", None, 3, 500, "target_unavailable"), "o003": ("rejected", None, 1, 422, "missing_required"), "o004": ("accepted", True, 2, 201, None), "o005": ("accepted", False, 2, 200, None), "o006": ("rejected", None, 1, 418, "http_418"), "o100": ("accepted", True, 1, 201, None)}
    assert got["o003"].message == "no" and got["o100"].request_id == "r-o100"
    assert target.headers[0]["Authorization"] == "Bearer t" and target.headers[0]["X-Namespace"] == "n1"
    # What the target holds is what was accepted, and sending all again changes nothing.
    held = held_ids(spark, f"{url}/organizations", "organization_id", page_size=7, pages_per_task=4)
    accepted = {i for i, r in got.items() if r.outcome == "accepted"}
    assert sorted(r.id for r in held.collect()) == sorted(accepted)
    again = send(payloads(spark, rows), url=f"{url}/organizations", folder=str(tmp_path / "again"), attempts=1)
    assert {r.id for r in again.where("outcome = 'accepted' and not created").collect()} == accepted
    changed = send(payloads(spark, [("o100", "other")]), url=f"{url}/organizations", folder=str(tmp_path / "changed")).first()
    assert (changed.outcome, changed.error_type) == ("rejected", "duplicate_identifier")
    assert send(payloads(spark, rows).where("false"), url=url, folder=str(tmp_path / "none")).count() == 0


def test_files_of_lost_tasks_are_not_read(spark, serve, tmp_path):
    rows = [("a", "1"), ("b", "2")]
    out = send(payloads(spark, rows), url=serve(Target()), folder=str(tmp_path / "run"))
    (kept,) = {p.parent for p in (tmp_path / "run" / "data").glob("*.parquet")}
    (kept / "part-lost.parquet").write_bytes(next(kept.glob("*.parquet")).read_bytes())
    assert outcomes(spark, str(tmp_path / "run")).count() == out.count() == 2


def test_waits_and_silence():
    waits, answers = [], iter([(503, {"retry-after": "99"}, b""), TimeoutError(), ConnectionResetError("gone"), (503, {}, b"")])

    def post(url, body, headers, timeout):
        x = next(answers)
        if isinstance(x, Exception):
            raise x
        return x

    out = Sender("u", attempts=4, step=0.5, longest_wait=10).send("i", "{}", post, waits.append)
    assert waits == [10, 1.0, 1.5] and (out["outcome"], out["attempts"], out["error_type"]) == ("failed", 4, "http_503")
    late = Sender("u", attempts=1).send("i", "{}", lambda *a: (_ for _ in ()).throw(TimeoutError()), waits.append)
    assert late["error_type"] == "timeout"
