"""A target behind HTTP as a Python data source: records are sent in tasks, one by one, and every answer is kept.

    outcomes = send(records, url=..., folder=..., token=..., namespace=...)

A record carries its own identifier and the target knows its content, so that sending it again changes nothing: a lost
task, a retry after a time-out and a second run are all safe. Each task writes its outcomes to a file of its own; only
the files of the tasks that were committed are named in the manifest, which is what readers go by.
"""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from quayside.sources.paged import PagedSource, headers_of, retry_after

RETRIED = {408, 425, 429, 500, 502, 503, 504}
#: Answers are kept up to so many characters.
MESSAGE, BODY = 200, 500
#: Outcomes that a task holds before it writes them.
HELD = 10_000

OUTCOMES = "id string, outcome string, created boolean, attempts int, status int, error_type string, message string, request_id string, body string"
_ARROW = pa.schema([("id", pa.string()), ("outcome", pa.string()), ("created", pa.bool_()), ("attempts", pa.int32()), ("status", pa.int32()), ("error_type", pa.string()), ("message", pa.string()), ("request_id", pa.string()), ("body", pa.string())])


def post(url: str, body: bytes, headers: dict[str, str], timeout: float) -> tuple[int, dict, bytes]:
    """(status, headers, body) of any answer; raises where there is none."""
    request = urllib.request.Request(url, data=body, headers={"Content-Type": "application/json", **headers}, method="POST")
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return answer.status, dict(answer.headers), answer.read()
    except urllib.error.HTTPError as e:
        return e.code, dict(e.headers or {}), e.read()


def _parsed(body: bytes):
    try:
        return json.loads(body)
    except ValueError:
        return None


def read_answer(status: int, body: bytes) -> dict:
    """What an answer means: accepted, rejected, or failed where waiting may help."""
    text, said = body.decode("utf-8", "replace"), _parsed(body)
    if status in (200, 201):
        if isinstance(said, dict) and "created" in said:
            return {"outcome": "accepted", "created": bool(said["created"])}
        return {"outcome": "failed", "error_type": "malformed_response", "message": "the answer is no write result", "body": text[:BODY]}
    error = said.get("error") if isinstance(said, dict) else None
    error = error if isinstance(error, dict) else {}
    outcome = "failed" if status in RETRIED else "rejected"
    return {"outcome": outcome, "error_type": str(error.get("type") or f"http_{status}"), "message": str(error.get("message") or text[:MESSAGE]), "body": text[:BODY]}


@dataclass(frozen=True)
class Sender:
    url: str
    token: str | None = None
    namespace: str | None = None
    prefix: str = "run"
    attempts: int = 4
    step: float = 0.5
    longest_wait: float = 10.0
    timeout: float = 30.0

    def send(self, record_id: str, payload: str, post: Callable = post, sleep: Callable = time.sleep) -> dict:
        """One record, tried again while it fails in a way that time may mend: after what the target asks for, but no longer than longest_wait."""
        request_id = f"{self.prefix}-{record_id}"
        headers = {**headers_of(self.token, self.namespace), "X-Request-Id": request_id}
        out: dict = {}
        for attempt in range(1, max(1, self.attempts) + 1):
            wait = None
            try:
                status, answered, body = post(self.url, payload.encode(), headers, self.timeout)
                out = {"status": status, **read_answer(status, body)}
                wait = retry_after(next((v for k, v in answered.items() if k.lower() == "retry-after"), None))
            except TimeoutError:
                out = {"outcome": "failed", "error_type": "timeout", "message": f"no answer within {self.timeout} s"}
            except (urllib.error.URLError, OSError) as e:
                late = isinstance(getattr(e, "reason", None), TimeoutError)
                out = {"outcome": "failed", "error_type": "timeout" if late else "transport_error", "message": f"{type(e).__name__}: {e}"[:MESSAGE]}
            out |= {"id": record_id, "attempts": attempt, "request_id": request_id}
            if out["outcome"] != "failed":
                break
            if attempt < self.attempts:
                sleep(min(wait, self.longest_wait) if wait is not None else self.step * attempt)
        return out


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """In a task: the store of a qualified path, and the name in it."""
    path = re.sub("^s3[an]:", "s3:", path)
    return fs.FileSystem.from_uri(re.sub("^file:/+", "/", path))


@dataclass
class Sent(WriterCommitMessage):
    file: str | None
    tally: dict


class TargetWriter(DataSourceWriter):
    def __init__(self, options):
        o = dict(options)
        own = {k: type(v)(o[k]) for k, v in {"attempts": 0, "step": 0.0, "timeout": 0.0}.items() if k in o}
        if "longest_wait" in o:  # options have no case
            own["longest_wait"] = float(o["longest_wait"])
        self.sender = Sender(o["url"], o.get("token"), o.get("namespace"), o.get("prefix", "run"), **own)
        self.folder = o["folder"]

    def write(self, iterator: Iterator) -> Sent:
        store, folder = _store(self.folder)
        store.create_dir(f"{folder}/data", recursive=True)
        name, tally, held, writer = f"part-{uuid.uuid4().hex}.parquet", {}, [], None
        try:
            for row in iterator:
                held.append(self.sender.send(row["id"], row["payload"]))
                tally[held[-1]["outcome"]] = tally.get(held[-1]["outcome"], 0) + 1
                if len(held) >= HELD:
                    writer = writer or pq.ParquetWriter(f"{folder}/data/{name}", _ARROW, filesystem=store)
                    writer.write_table(pa.Table.from_pylist(held, schema=_ARROW))
                    held = []
            if held:
                writer = writer or pq.ParquetWriter(f"{folder}/data/{name}", _ARROW, filesystem=store)
                writer.write_table(pa.Table.from_pylist(held, schema=_ARROW))
        finally:
            if writer:
                writer.close()
        return Sent(name if tally else None, tally)

    def commit(self, messages) -> None:
        store, folder = _store(self.folder)
        store.create_dir(folder, recursive=True)
        tally: dict[str, int] = {}
        for m in filter(None, messages):
            for k, n in m.tally.items():
                tally[k] = tally.get(k, 0) + n
        manifest = {"files": sorted(m.file for m in messages if m and m.file), "tally": tally}
        with store.open_output_stream(f"{folder}/committed.json") as out:
            out.write(json.dumps(manifest).encode())

    def abort(self, messages) -> None:
        store, folder = _store(self.folder)
        for m in messages:
            if m and m.file:
                store.delete_file(f"{folder}/data/{m.file}")


class TargetSource(DataSource):
    @classmethod
    def name(cls):
        return "target"

    def writer(self, schema, overwrite):
        if missing := {"id", "payload"} - {f.name for f in schema.fields}:
            raise ValueError(f"records need {sorted(missing)}")
        return TargetWriter(self.options)


def qualified(spark: SparkSession, path: str) -> str:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()


def send(records: DataFrame, url: str, folder: str, **options) -> DataFrame:
    """Sends records (id, payload as JSON) and returns their outcomes as a table under `folder`.

    Of rows that repeat an id all are sent; the target tells them apart by their content. options: token, namespace,
    prefix, attempts, step, longest_wait, timeout. As many records are sent at a time as there are tasks.
    """
    spark = records.sparkSession
    spark.dataSource.register(TargetSource)
    folder = qualified(spark, folder.rstrip("/"))
    given = {k: str(v) for k, v in options.items() if v is not None}
    records.select("id", "payload").write.format("target").mode("append").options(url=url, folder=folder, **given).save()
    return outcomes(spark, folder)


def outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """What `send` has committed under a folder."""
    manifest = json.loads("\n".join(r["value"] for r in spark.read.text(f"{folder}/committed.json").collect()))
    if not manifest["files"]:
        return spark.createDataFrame([], OUTCOMES)
    return spark.read.schema(OUTCOMES).parquet(*[f"{folder}/data/{f}" for f in manifest["files"]])


def held_ids(spark: SparkSession, url: str, column: str, **options) -> DataFrame:
    """(id) of everything that the target lists, as it says itself; options as for a paged feed."""
    spark.dataSource.register(PagedSource)
    given = {k: str(v) for k, v in options.items() if v is not None}
    listed = spark.read.format("paged").options(url=url, style="offset", **given).schema(f"{column} string").load()
    return listed.select(F.col(column).alias("id")).where("id is not null").distinct()
