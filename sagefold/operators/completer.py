"""Model calls as a stored table.

Requests are rows named by their content, results a table that only grows.
Plans never call a model: a run goes through what no good result answers, asks in
rounds, and appends each round's answers.  Batches are noted with their requests
when they are sent, and collected by this run or a later one.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from itertools import islice
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import RESULT
from . import ledger

CONCURRENCY = 4
BATCH_REQUESTS, BATCH_BYTES = 5000, 150 << 20
FINE = ("end_turn", "stop_sequence")


class Completer(Protocol):
    """What answers requests."""

    def complete(self, request: dict) -> dict:
        """text, stop_reason, input_tokens, output_tokens of an answer."""

    def count_tokens(self, request: dict) -> int: ...


class Offline:
    """Answers by rule, without a network: the same request has the same answer."""

    def __init__(self, answer=None):
        self.answer, self.calls = answer or (lambda request: {}), 0

    def complete(self, request: dict) -> dict:
        self.calls += 1
        return {"text": json.dumps(self.answer(request)), "stop_reason": "end_turn", "input_tokens": self.count_tokens(request), "output_tokens": 1}

    def count_tokens(self, request: dict) -> int:
        return len(request["prompt"].encode()) // 3 + 1


def error_of(stop_reason: str | None) -> str:
    """Why an answer does not count; empty for good ones."""
    if stop_reason in FINE:
        return ""
    return {"refusal": "the model refused", "max_tokens": "the answer was cut off"}.get(stop_reason or "", f"stopped: {stop_reason}")


def request_id(prefix: str, prompt: str) -> str:
    return f"{prefix}-{hashlib.sha256(prompt.encode()).hexdigest()[:10]}"


def stored(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(RESULT).parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], RESULT)


def latest_results(results: DataFrame) -> DataFrame:
    """One result of each request: a good one before a failed one, then the newest."""
    good = F.coalesce("error", F.lit("")) == ""
    return results.groupBy("id").agg(F.max_by(F.struct(*[c for c in results.columns if c != "id"]), F.struct(good.cast("int").alias("g"), "completed_at")).alias("r")).select("id", "r.*")


def _save(spark: SparkSession, answers: list[tuple], path: str) -> None:
    fields = RESULT.removesuffix(", completed_at timestamp")
    spark.createDataFrame(answers, fields).coalesce(1).withColumn("completed_at", F.current_timestamp()).write.mode("append").parquet(path)


def run_sync(requests: DataFrame, completer: Completer, path: str, model: str = "offline", concurrency: int = CONCURRENCY) -> DataFrame:
    """Answer what is unanswered, ``concurrency`` calls at a time, and return the results of all requests.

    The answers of each round are stored before the next begins, so that a crash
    loses those of one round at most; the driver holds one round.  Failed ones are
    stored too and asked again by the next run.
    """
    spark = requests.sparkSession
    none = spark.createDataFrame([], "id string")

    def ask(r: dict) -> tuple:
        try:
            a = completer.complete(r)
            return r["id"], a["text"], model, a["stop_reason"], a["input_tokens"], a["output_tokens"], 0, error_of(a["stop_reason"])
        except Exception as error:  # noqa: BLE001  one failed call must not lose the others
            return r["id"], None, model, "error", 0, 0, 0, str(error) or type(error).__name__

    todo = (r.asDict() for r in ledger.unsent(requests, latest_results(stored(spark, path)), none).dropDuplicates(["id"]).toLocalIterator())
    with ThreadPoolExecutor(concurrency) as pool:
        while some := list(islice(todo, concurrency)):
            _save(spark, list(pool.map(ask, some)), path)
    return latest_results(stored(spark, path)).join(requests.select("id"), "id", "left_semi")


BATCH = "batch string, ids array<string>, state string, at timestamp"


class Batcher(Protocol):
    """What answers many requests later."""

    def submit(self, requests: list[dict]) -> str: ...

    def done(self, batch: str) -> bool: ...

    def collect(self, batch: str) -> list[dict]:
        """id, text, stop_reason, input_tokens, output_tokens of each request, in any order."""


def in_flight(spark: SparkSession, path: str) -> DataFrame:
    """(batch, ids) of the batches whose last state is ``sent``."""
    last = _states(spark, path).groupBy("batch").agg(F.max_by(F.struct("ids", "state"), "at").alias("x"))
    return last.filter("x.state = 'sent'").select("batch", "x.ids")


def _states(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(BATCH).parquet(f"{path}-batches")
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], BATCH)


def _mark(spark: SparkSession, path: str, batch: str, ids: list[str], state: str) -> None:
    spark.createDataFrame([(batch, ids, state)], "batch string, ids array<string>, state string").withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{path}-batches")


def submit(requests: DataFrame, batcher: Batcher, path: str) -> int:
    """Send what has no good result and is in no batch; the number of requests sent.  A batch is noted as soon as it has a name."""
    spark = requests.sparkSession
    flying = in_flight(spark, path).select(F.explode("ids").alias("id"))
    todo = ledger.unsent(requests, latest_results(stored(spark, path)), flying).dropDuplicates(["id"])
    sizes = ((r["id"], r["n"]) for r in todo.select("id", (F.octet_length("prompt") + F.octet_length("system") + F.octet_length("schema")).alias("n")).orderBy("id").toLocalIterator())
    sent = 0
    for ids in batches(sizes):
        rows = [r.asDict() for r in todo.filter(F.col("id").isin(ids)).collect()]
        _mark(spark, path, batcher.submit(rows), ids, "sent")
        sent += len(ids)
    return sent


def collect(spark: SparkSession, batcher: Batcher, path: str, model: str = "offline") -> int:
    """Store the answers of the batches that are done; the number of batches still out.  What a batch did not answer is stored as failed."""
    left = 0
    for r in in_flight(spark, path).collect():
        if not batcher.done(r["batch"]):
            left += 1
            continue
        found = {a["id"]: (a["id"], a["text"], model, a["stop_reason"], a["input_tokens"], a["output_tokens"], 0, error_of(a["stop_reason"])) for a in batcher.collect(r["batch"])}
        _save(spark, [found.get(k) or (k, None, model, "error", 0, 0, 0, "no answer in the batch") for k in r["ids"]], path)
        _mark(spark, path, r["batch"], r["ids"], "collected")
    return left


def run_batch(requests: DataFrame, batcher: Batcher, path: str, model: str = "offline", deadline: float = 86_400, wait: float = 30) -> DataFrame:
    """Submit, poll until all batches are done or ``deadline`` seconds are over, collect; a later run goes on where this one stopped."""
    spark, began = requests.sparkSession, time.monotonic()
    submit(requests, batcher, path)
    while collect(spark, batcher, path, model) and time.monotonic() - began < deadline:
        time.sleep(wait)
    return latest_results(stored(spark, path)).join(requests.select("id"), "id", "left_semi")


def batches(sizes: Iterable[tuple[str, int]]) -> list[list[str]]:
    """Requests in batches by number and bytes, in order."""
    out: list[list[str]] = []
    filled = 0
    for name, size in sizes:
        if not out or len(out[-1]) >= BATCH_REQUESTS or filled + size > BATCH_BYTES:
            out.append([])
            filled = 0
        out[-1].append(name)
        filled += size
    return out
