"""Orders over all rows, numbered records and archives."""

import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F

from assertlake.operators import ordered
from assertlake.sources import records


@pytest.fixture
def small_splits(spark):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    was = {k: spark.conf.get(k) for k in keys}

    def use(size):
        spark.conf.set(keys[0], size)
        spark.conf.set(keys[1], "1")

    yield use
    for k, v in was.items():
        spark.conf.set(k, v)


def test_numbers_of_lines_under_any_splits(spark, tmp_path, small_splits):
    (tmp_path / "d").mkdir()
    want = []
    for name, n in (("a", 300), ("b", 0), ("c", 7), ("e", 150)):
        lines = [json.dumps({"id": i, "nl": "é" * (i % 40)}, ensure_ascii=False) if i % 9 else ("" if i % 2 else '{"id": 1,') for i in range(n)]
        (tmp_path / "d" / f"{name}.jsonl").write_bytes(("\r\n" if name == "c" else "\n").join(lines).encode())
        want += [(name, k, x) for k, x in enumerate(lines)]
    for size in ("128m", "700", "97"):
        small_splits(size)
        rows = records.numbered_lines(spark, f"{tmp_path}/d")
        got = [(r.file.rsplit("/", 1)[1][0], r.place, r.line) for r in rows.collect()]
        assert sorted(got) == sorted(want)
        assert size == "128m" or spark.read.text(f"{tmp_path}/d").rdd.getNumPartitions() >= 10
    read = records.records(spark, f"{tmp_path}/d", "id long, nl string", [("/a", "first", 1), ("jsonl", "rest", 2)])
    got = {(r.tag, r.rank, r.file.rsplit("/", 1)[1][0]) for r in read.collect()}
    assert got == {("first", 1, "a"), ("rest", 2, "c"), ("rest", 2, "e")}
    assert read.where("_corrupt_record is not null").count() == sum(x == '{"id": 1,' for *_, x in want)
    assert read.where("tag = 'first' and place = 11").first().id == 11


def test_counts_on_the_way(spark, tmp_path):
    rows = spark.createDataFrame([(k,) for k in [1, 2, 2, 3, None]], "k long")
    out, seen = records.matched(rows, spark.createDataFrame([(2, "x"), (9, "y")], "k long, v string"), "k")
    out.write.parquet(f"{tmp_path}/out")
    assert seen.get == {"rows": 5, "hits": 2, "misses": 3}
    assert sorted((str(r.k), r.v, r.matched) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [("1", None, False), ("2", "x", True), ("2", "x", True), ("3", None, False), ("None", None, False)]


@pytest.mark.parametrize("whole", [1 << 20, 0])
def test_archives_member_by_member(spark, tmp_path, whole):
    (tmp_path / "t").mkdir()

    def archive(name, n, cut=None):
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w:gz") as tar:
            for k in range(n):
                import random

                text = "".join(random.Random(k).choices("abcdef \n", k=20_000)).encode() + b"\xff"
                info = tarfile.TarInfo(f"src/{k}.{'sv' if k % 2 else 'txt'}")
                info.size = len(text)
                tar.addfile(info, io.BytesIO(text))
        (tmp_path / "t" / name).write_bytes(out.getvalue()[:cut])

    archive("good.tar.gz", 6)
    archive("cut.tgz", 6, cut=40_000)
    archive("empty.tar.gz", 0)
    (tmp_path / "t/none.tar.gz").write_bytes(b"no archive")
    rows = [(r.archive.rsplit("/", 1)[1], r.path, r.text and len(r.text), r.error) for r in records.archives(spark, f"{tmp_path}/t", whole_bytes=whole).collect()]
    assert sorted(r[:3] for r in rows if r[0] == "good.tar.gz") == [("good.tar.gz", f"src/{k}.sv", 20_000) for k in (1, 3, 5)]
    cut = [r for r in rows if r[0] == "cut.tgz"]
    assert sum(r[3] is None for r in cut) >= 1 and sum(r[3] is not None for r in cut) == 1  # the good members, and one row that says what happened
    assert [r[3] is not None for r in rows if r[0] == "none.tar.gz"] == [True] and not [r for r in rows if r[0] == "empty.tar.gz" and not r[3]]


@pytest.mark.parametrize("ranges", [1, 7])
def test_places_sums_and_budgets(spark, ranges):
    costs = [(k * 37 % 101, (k * 7) % 5 if k % 11 else None) for k in range(100)]
    df = spark.createDataFrame(costs, "k long, cost long").repartition(5)
    want = sorted(costs)
    got = sorted(map(tuple, ordered.with_place(df, ["k"], ranges=ranges).collect()))
    assert got == [(k, c, i) for i, (k, c) in enumerate(want)]
    sums = sorted(map(tuple, ordered.prefix_sum(df, ["k"], F.coalesce("cost", F.lit(0)), "s", ranges=ranges).collect()))
    assert [s for *_, s in sums] == [sum(c or 0 for _, c in want[: i + 1]) for i in range(100)]
    for budget in (0, 1, 50, 101, 10_000):
        kept = sorted(map(tuple, ordered.within_budget(df, ["k"], F.col("cost"), budget, ranges).collect()))
        assert kept == [x for i, x in enumerate(want) if sum(c or 0 for _, c in want[: i + 1]) <= budget]
    assert [r.k for r in ordered.first_rows(df, ["k"], 3, ranges).orderBy("k").collect()] == [k for k, _ in want[:3]]
    assert ordered.first_rows(df.limit(0), ["k"], 3, ranges).count() == 0
    # no window sees more than a range, but for those over the ranges' totals
    plan = ordered.within_budget(df, ["k"], F.col("cost"), 50, ranges)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") == 3  # two over totals, one in the last range
