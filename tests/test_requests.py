"""Requests to outside tools: one row for each, whatever the tool does; rounds and chains that don't ask twice."""

import itertools
import threading
import time

import pytest
from pyspark.sql import functions as F

from assertlake.operators import pool, rounds

DESIGN = "module m(input clk);\nendmodule"


def run(answer, n, **policy):
    rows = pool.told(answer, iter([{"key": k} for k in range(n)]), pool.Policy(**policy))
    return {r["key"]: (status, attempts, answers) for r, status, attempts, _, answers in rows}


def test_every_request_gets_one_row():
    tries, most, now, lock = {}, [0], [0], threading.Lock()

    def tool(request):
        k = request["key"]
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
            tries[k] = tries.get(k, 0) + 1
        try:
            if k == 3:
                time.sleep(3)  # hangs, then answers late
            if k == 4 and tries[k] < 3:
                raise pool.Again
            if k == 5:
                raise ValueError("broken")
            if k == 6:
                raise ConnectionError
            time.sleep(0.02)
            return None if k == 7 else [{"v": k}, {"v": -k}] if k == 8 else {"v": k}
        finally:
            with lock:
                now[0] -= 1

    began = time.monotonic()
    got = run(tool, 40, seconds=0.6, at_once=4, attempts=3, wait=0.05)
    assert len(got) == 40 and time.monotonic() - began < 3
    assert got[3] == ("TIMEOUT", 1, []) and got[4] == ("OK", 3, [{"v": 4}]) and got[5] == ("EXCEPTION:ValueError", 1, []) and got[6] == ("EXCEPTION:ConnectionError", 3, [])
    assert got[7] == ("EMPTY", 1, []) and got[8][2] == [{"v": 8}, {"v": -8}] and got[9] == ("OK", 1, [{"v": 9}])
    assert 2 <= most[0] <= 5  # the one that hangs no longer counts when its time is over


def test_requests_are_taken_as_they_are_run():
    """No more are held than run or wait, and answers leave before the last request is read."""
    read = []

    def requests():
        for k in range(50):
            read.append(k)
            yield {"key": k}

    out = pool.told(lambda r: {"v": r["key"]}, requests(), pool.Policy(at_once=3))
    for n, _ in enumerate(out):
        assert len(read) <= n + 1 + 3
    assert len(read) == 50


def test_late_tries_and_own_limits():
    def tool(request):
        time.sleep(0.3)
        return {"v": 1}

    assert run(tool, 1, seconds=0.1, attempts=2, wait=0.01, late=True)[0][:2] == ("TIMEOUT", 2)
    rows = pool.told(tool, iter([{"key": 0, "seconds": 2}, {"key": 1, "seconds": None}]), pool.Policy(seconds=0.1))
    assert {r["key"]: s for r, s, *_ in rows} == {0: "OK", 1: "TIMEOUT"}


def test_schemas_of_the_callers_own(spark):
    rows = spark.createDataFrame([(k, f"p{k % 3}", {"x": k}) for k in range(20)], "key long, prompt string, more map<string,int>")
    got = pool.answered(rows, lambda r: [{"text": r["prompt"], "n": r["more"]["x"], "other": 1}, {"text": None}], "text string, n int", partitions=3).collect()
    assert sorted(r.key for r in got) == list(range(20)) and all([tuple(a) for a in r.answers] == [(f"p{r.key % 3}", r.key), (None, None)] for r in got)
    assert pool.answered(rows.limit(0), lambda r: {}, "text string").count() == 0


def test_cache_and_equal_requests(spark):
    asked = spark.sparkContext.accumulator(0)

    def tool(request):
        asked.add(1)
        return {"v": request["key"]}

    rows = spark.createDataFrame([(k % 5,) for k in range(20)], "key long")
    first = pool.once(rows, tool, "v long").cache()
    assert first.count() == 5 and asked.value == 5
    cache = first.where("key < 3").unionByName(first.where("key = 3").withColumn("status", F.lit("TIMEOUT")))
    assert sorted(r.key for r in pool.once(rows, tool, "v long", cache).collect()) == [0, 1, 2, 3, 4] and asked.value == 7


def test_rounds_go_on_after_a_kill(spark, tmp_path):
    """Ids are satisfied in the round of their remainder. A run that dies in round 2 goes on there and ends like one that doesn't."""
    rows = spark.range(40).withColumnRenamed("id", "key")
    seen = []

    def step(open_, k, die=None):
        seen.append((k, open_.count()))
        if k == die:
            raise RuntimeError("killed")
        return open_.withColumn("ok", F.col("key") % 4 <= k)

    whole = rounds.rounds(rows, step, F.col("ok"), f"file://{tmp_path}/a", 10)
    want = sorted(map(tuple, whole.collect()))
    assert seen == [(0, 40), (1, 30), (2, 20), (3, 10)] and len(want) == 100  # ends when nothing is open
    seen.clear()
    at = f"file://{tmp_path}/b"
    with pytest.raises(RuntimeError):
        rounds.rounds(rows, lambda o, k: step(o, k, die=2), F.col("ok"), at, 10)
    again = rounds.rounds(rows.repartition(7), step, F.col("ok"), at, 10)
    assert sorted(map(tuple, again.collect())) == want and seen == [(0, 40), (1, 30), (2, 20), (2, 20), (3, 10)]
    with pytest.raises(ValueError, match="other rows"):
        rounds.rounds(rows.limit(3), step, F.col("ok"), at, 10)
    assert rounds.rounds(rows.limit(0), step, F.col("ok"), f"file://{tmp_path}/c", 10).count() == 0


LOGS = {
    "fail": "engine_0 (smtbmc z3) returned FAIL", "odd": "nothing known", "syntax": "ERROR: syntax error\nengine_0 (smtbmc z3) returned PASS", "cover": "cover point unreachable",
}


def test_verification_by_gates(spark):
    asked = spark.sparkContext.accumulator(0)

    def prover(request):
        asked.add(1)
        assert request["depth"] == 10 and "always_ff" in request["rtl"]
        if "slow" in request["rtl"]:
            time.sleep(5)
        name = next((n for n in LOGS if n in request["rtl"]), None)
        return {"log": LOGS.get(name, "engine_0 (smtbmc z3) returned PASS")}

    sva = lambda x: f"assert property (@(posedge clk) a |-> {x});"
    texts = {"true": sva("1'b1"), "live": "assert property (@(posedge clk) s_eventually a);", "no end": sva("b"), "cached": sva("c"), "pass": sva("d"), "pass too": sva("d"), "slow": sva("slow")} | {n: sva(n) for n in LOGS}
    rows = spark.createDataFrame([(k, s, "module m;" if k == "no end" else DESIGN) for k, s in texts.items()] + [("null", None, None)], "key string, sva string, rtl string")
    pairs = {r.key: r.pair for r in rounds.verified(rows.where("key = 'cached'"), lambda r: {"log": ""}).collect()}
    cache = spark.createDataFrame([(pairs["cached"], "PASS")], "key string, status string")
    out = rounds.verified(rows, prover, pool.Policy(seconds=1.0), cache=cache)
    got = {r.key: r for r in out.collect()}
    status = {k: (r.gate, r.status, r.reward) for k, r in got.items()}
    assert status == {
        "true": ("vacuity", "VACUOUS", 0.2), "live": ("lowering", "UNSUPPORTED", None), "null": ("lowering", "UNSUPPORTED", None), "no end": ("injection", "EXTRACT_ERROR", 0.0), "cached": ("cache", "PASS", 1.0),
        "pass": ("prover", "PASS", 1.0), "pass too": ("prover", "PASS", 1.0), "slow": ("prover", "TIMEOUT", 0.3), "fail": ("prover", "FAIL", 0.5), "odd": ("prover", "FAIL", 0.5),
        "syntax": ("prover", "PARSE_ERROR", 0.0), "cover": ("prover", "VACUOUS", 0.2),
    }
    n = asked.value
    assert got["true"].notes[0].startswith("vacuity detected") and got["cached"].notes[0] == "cache hit" and got["pass"].lowered and got["true"].tcl == 0
    assert n == 6  # each open pair once: d, slow and the four logs, and none that a gate has decided


def test_paraphrases_and_alternatives(spark, tmp_path):
    rows = spark.createDataFrame([("r1", "the request is granted", "assert property (a |-> b);", ["assert property (a |-> b2);"]), ("r2", "silence", "assert property (c);", None)], "id string, nl string, reference_sva string, alt_svas array<string>")

    def model(request):
        assert request["system"] == "S" and request["top_p"] == 0.95
        if "silence" in request["prompt"]:
            raise ValueError
        if "paraphrases" in request["prompt"]:
            return {"text": "<think>so</think>1. the grant follows the request\n- short\n* a grant comes for a request"}
        return [{"text": f"```systemverilog\nassert property (a  |-> {x});\n```"} for x in ("b2", "b3", "b4")[: request["k"]]] + [{"text": f"assert property (t{request['temperature']});"}]

    got = sorted(tuple(r) for r in rounds.paraphrased(rows, model, "S", 2).select("id", "src_id", "nl", "is_original_nl").collect())
    assert got == [
        ("r1__pp0", "r1", "the request is granted", True), ("r1__pp1", "r1", "the grant follows the request", False), ("r1__pp2", "r1", "a grant comes for a request", False), ("r2__pp0", "r2", "silence", True),
    ]
    specs = [{"temp": 0.7, "k": 2, "max": 64}, {"temp": 0.95, "k": 3, "max": 64}]
    for _ in range(2):  # the second time all comes from the folders
        got = {r.id: r.alt_svas for r in rounds.alternatives(rows, model, "S", specs, f"file://{tmp_path}/alts").collect()}
        model = None
    assert got == {"r1": ["assert property (a |-> b2);", "assert property (a  |-> b3);", "assert property (t0.7);", "assert property (a  |-> b4);", "assert property (t0.95);"], "r2": []}


def test_judged_pool(spark):
    alts = ["x1", "x2", "ref  ", "x3", "x 2", "x1"]
    rows = spark.createDataFrame([("r", "ref", alts), ("none", "ref", None)], "id string, reference_sva string, alt_svas array<string>")
    verdicts = [("x1", "IMPLIES_LM_TO_REF"), ("x2", "NOT_EQUIVALENT"), ("ref  ", "EQUIVALENT"), ("x3", "EQUIVALENT"), ("x 2", "TIMEOUT")]
    judged = spark.createDataFrame([("r", *v) for v in verdicts], "id string, sva string, verdict string")
    got = {r.id: (r.ref_svas, r.n_extra_refs) for r in rounds.judged_pool(rows, judged).collect()}
    assert got == {"r": (["ref", "x3", "x1"], 2), "none": (["ref"], 0)}


def test_keys_of_generations_tell_all_that_decides(spark):
    rows = spark.createDataFrame([("a",), ("b",), (None,)], "nl string")
    made = [pool.generation(rows, s, F.col("nl"), k, t, seed=seed) for s, k, t, seed in itertools.product(("s", "z"), (1, 2), (0.5, 0.7), (0, 1))]
    keys = [r.key for df in made for r in df.select("key").collect()]
    assert len(keys) == len(set(keys)) == 48
