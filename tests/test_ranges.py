"""Running measures by ranges against plain loops: one group with most of the rows, and few or many ranges."""

import random

import pytest
from pyspark.sql import functions as F

from assertlake.operators import curate, evaluate


def made(n=120):
    r = random.Random(6)
    return [("hot" if r.random() < 0.6 else f"g{r.randrange(5)}", k, r.choice([None, *range(1, 30)])) for k in r.sample(range(1000), n)] + [(None, 5, 1), (None, 6, 3)]


@pytest.mark.parametrize("ranges", [1, 9])
def test_best_so_far_and_cap(spark, ranges):
    rows = made()
    df = spark.createDataFrame(rows, "g string, k int, v int").repartition(4)
    streaks, kept = [], []
    for g in {x[0] for x in rows}:
        best, at, last, total, cut = None, 0, 0, 0, False
        for _, k, v in sorted(x for x in rows if x[0] == g):
            at += 1
            improved = True if best is None else None if v is None else v > best
            last = at if improved else last
            streaks.append((str(g), k, best, improved, at - last))
            best = max(x for x in (best, v) if x is not None) if v is not None or best is not None else None
            total += v or 0
            cut = cut or total > 100
            if not cut:
                kept.append((str(g), k))
    got = [(str(x.g), x.k, x.best, x.improved, x.bad_streak) for x in evaluate.best_so_far(df, "g", "k", "v", ranges).collect()]
    assert sorted(got, key=str) == sorted(streaks, key=str)
    assert sorted((str(x.g), x.k) for x in evaluate.running_cap(df, "g", "k", "v", 100, ranges).collect()) == sorted(kept)


@pytest.mark.parametrize("ranges", [1, 9])
def test_last_before_with_an_outlier(spark, ranges):
    r = random.Random(8)
    marks = [("hot" if r.random() < 0.7 else "b", k, r.choice([None, f"m{k}"])) for k in r.sample(range(300), 60)] + [("hot", 10**15, "far")]
    points = [(i, "hot" if i % 3 else "b", r.randrange(320)) for i in range(150)] + [(999, "hot", 10**16), (998, "none", 5)]
    m = spark.createDataFrame(marks, "key string, at long, mark string")
    p = spark.createDataFrame(points, "id int, key string, at long")
    want = {i: max([(k, x) for y, k, x in marks if y == key and x is not None and k <= at], default=(0, None))[1] for i, key, at in points}
    assert {x.id: x.mark for x in curate.last_before(p, m, "key", "at", "mark", ranges).collect()} == want


def test_collected_values_once(spark):
    rows = [("k", i % 2, i, x, "First") for i, x in enumerate(["b", "B", "a", None, "First", "a", "c"])] + [("n", 0, 0, None, "only")]
    df = spark.createDataFrame(rows, "key string, rank int, ord int, value string, canon string")
    got = {x.key: (x.refs, x.n_extra) for x in curate.collected(df, "key", "rank", "ord", "value", F.lower("value"), "canon").collect()}
    assert got == {"k": (["First", "b", "a", "c"], 3), "n": (["only"], 0)}
