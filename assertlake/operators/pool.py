"""Requests to outside tools and models, answered within tasks: a bounded number at once, each with a timeout, failures tried again.

An answerer is a function of one request (a dict of the request's columns) that returns an answer (a dict of the answer's fields) or a list of them; what runs it (a
subprocess, a socket, a client) is its own matter. Every request gets exactly one row: OK, EMPTY (no answer), TIMEOUT, or EXCEPTION:<type>. A request whose
time is over gets its row then, whatever it does later; it no longer counts as running. Requests and answers have schemas of the caller's own, so
proofs, lint runs and generations (prompt, number, temperature) go the same way.

A task holds no more requests than it runs, with those that wait for another try; rows leave as they come. A lost task asks its requests anew,
unless a cache or rounds (operators/rounds.py) know the answers.
"""

from __future__ import annotations

import heapq
import itertools
import queue
import threading
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from assertlake.functions.keys import digest, text

Answerer = Callable[[dict], dict | list[dict] | None]

STATUS = "status string, attempts int, seconds double"


class Again(Exception):
    """Raised by an answerer for a failure that may pass."""


@dataclass(frozen=True)
class Policy:
    """seconds: for one try, unless the request has a column of that name; at_once: requests of a task that run together; attempts: tries in all, for the
    exceptions in again and, if late is set, for timeouts; wait: seconds before the second try, doubled for each further one."""

    seconds: float = 15.0
    at_once: int = 4
    attempts: int = 3
    wait: float = 0.5
    again: tuple[type[Exception], ...] = (Again, ConnectionError)
    late: bool = False
    rows: int = 64


def told(answer: Answerer, requests: Iterator[dict], policy: Policy) -> Iterator[tuple[dict, str, int, float, list[dict]]]:
    """(request, status, attempts, seconds, answers) as they come."""
    done: queue.Queue = queue.Queue()
    running: dict[int, tuple[dict, int, float, float]] = {}  # ticket: request, attempt, its begin, the request's begin
    waiting: list[tuple[float, int, dict, int, float]] = []  # when, tie, request, attempt, the request's begin
    tickets, more = itertools.count(), True

    def limit(request: dict) -> float:
        return policy.seconds if request.get("seconds") is None else float(request["seconds"])

    def run(ticket: int, request: dict) -> None:
        try:
            out = answer(dict(request))
            done.put((ticket, [out] if isinstance(out, dict) else list(out or []), None))
        except Exception as e:  # what a tool raises is an answer
            done.put((ticket, [], e))

    def begin(request: dict, attempt: int, first: float) -> None:
        ticket = next(tickets)
        running[ticket] = (request, attempt, time.monotonic(), first)
        threading.Thread(target=run, args=(ticket, request), daemon=True).start()

    def failed(status: str, again: bool, request: dict, attempt: int, first: float):
        now = time.monotonic()
        if again and attempt < policy.attempts:
            heapq.heappush(waiting, (now + policy.wait * 2 ** (attempt - 1), next(tickets), request, attempt + 1, first))
            return None
        return request, status, attempt, now - first, []

    while True:
        while len(running) < policy.at_once:
            if waiting and waiting[0][0] <= time.monotonic():
                _, _, request, attempt, first = heapq.heappop(waiting)
                begin(request, attempt, first)
            elif more and len(waiting) < 4 * policy.at_once:
                request = next(requests, None)
                if request is None:
                    more = False
                else:
                    begin(request, 1, time.monotonic())
            else:
                break
        if not running and not waiting:
            return
        ends = [at + limit(request) for request, _, at, _ in running.values()] + ([waiting[0][0]] if waiting and len(running) < policy.at_once else [])
        try:
            ticket, answers, error = done.get(timeout=max(0.0, min(ends) - time.monotonic()))
            if ticket in running:  # else it is late
                request, attempt, _, first = running.pop(ticket)
                if error is None:
                    yield request, "OK" if answers else "EMPTY", attempt, time.monotonic() - first, answers
                elif row := failed(f"EXCEPTION:{type(error).__name__}", isinstance(error, policy.again), request, attempt, first):
                    yield row
        except queue.Empty:
            pass
        now = time.monotonic()
        for ticket in [t for t, (request, _, at, _) in running.items() if at + limit(request) <= now]:
            request, attempt, _, first = running.pop(ticket)
            if row := failed("TIMEOUT", policy.late, request, attempt, first):
                yield row


def answered(requests: DataFrame, answer: Answerer, fields: str, policy: Policy = Policy(), key: str = "key", partitions: int | None = None) -> DataFrame:
    """(key, status, attempts, seconds, answers): a row for each row of requests; answers is an array of structs of fields, others than these are
    left out, missing ones null. The answerer is made ready once a task if it has a method `opened`. partitions: tasks that share the requests."""
    spark = requests.sparkSession
    kinds = T.StructType.fromDDL(fields)
    schema = T.StructType([requests.schema[key], *T.StructType.fromDDL(STATUS), T.StructField("answers", T.ArrayType(kinds))])
    names = kinds.fieldNames()
    arrow = spark.createDataFrame([], schema).toArrow().schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = answer.opened() if hasattr(answer, "opened") else answer
        rows = (row for batch in batches for small in range(0, batch.num_rows, policy.rows) for row in batch.slice(small, policy.rows).to_pylist(maps_as_pydicts="lossy"))
        out = []
        for request, status, attempts, seconds, answers in told(ready, rows, policy):
            out.append({key: request[key], "status": status, "attempts": attempts, "seconds": seconds, "answers": [{n: a.get(n) for n in names} for a in answers]})
            if len(out) == policy.rows:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return (requests.repartition(partitions) if partitions else requests).mapInArrow(run, schema)


def once(requests: DataFrame, answer: Answerer, fields: str, cache: DataFrame | None = None, key: str = "key", **more) -> DataFrame:
    """answered() for each key once (equal keys are equal requests), without the keys whose OK answer the cache has; those come from there."""
    single = requests.dropDuplicates([key])
    if cache is None:
        return answered(single, answer, fields, key=key, **more)
    known = cache.where("status = 'OK'").dropDuplicates([key])
    new = answered(single.join(known.select(key), key, "left_anti"), answer, fields, key=key, **more)
    return known.join(single.select(key), key, "left_semi").select(*new.columns).unionByName(new)


def generation(rows: DataFrame, system: str, user: Column, k: int, temperature: float, top_p: float = 0.95, max_tokens: int = 320, seed: int = 0) -> DataFrame:
    """rows with a request for k texts each: key (of all that decides the answer), system, prompt, k, temperature, top_p, max_tokens."""
    fixed = {"system": system, "k": k, "temperature": float(temperature), "top_p": float(top_p), "max_tokens": max_tokens}
    spec = F.lit("|||".join(map(str, [*fixed.values(), seed])))
    return rows.withColumns({"prompt": text(user), **{c: F.lit(v) for c, v in fixed.items()}}).withColumn("key", digest(F.concat(spec, F.lit("|||"), "prompt")))
