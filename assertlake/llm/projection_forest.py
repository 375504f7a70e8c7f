"""Embedding near-dedup by a forest of random-projection trees.

A node of a tree splits its vectors by a random direction: below a threshold to one child, above to the other, within a spill of it to both. The threshold is the
least crowded of the middle ranks, so that groups of close vectors stay together. A node is split while it holds more than LEAF vectors; a round
fits a few levels for every such node on a bounded sample of its vectors and sends all vectors down. In a leaf vectors are compared with each other, in
double precision; a pair counts in the first leaf that it shares only, so numbers of links are sums, pairs are never listed, and leaves give a spanning
forest of their links for the union.

Equal vectors are one, with a number. A group that holds a good share of the sample is a ball: vectors so near to its centre (half the angle of a link) that
any two are linked without comparing. They are compared with others only. Leaves of more than CELL vectors, which happen where no direction splits
a crowd, are compared cell by cell, a cell for two stretches of the leaf.

Vectors that are null, zero or hold null or non-finite components link with nothing; nor do vectors of different lengths, nor rows without vec_id (component_id null,
kept). A repeated row is another vector, equal to its first. An empty table gives no rows. Other columns, the label too, are not read.

Fitted on samples: thresholds (SAMPLE vectors of a node) and centres (BALL_SAMPLE vectors). Every vector goes down every tree. No link is below
the least cosine; links that no leaf has are lost (the tests measure recall).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from assertlake.llm.common import mix, removed, saved, written
from assertlake.llm.graph import components

LEAST = 0.95
TREES = 8
#: Vectors of a leaf; of a node's sample; levels that one round adds; directions tried for each split.
LEAF, SAMPLE, LEVELS, TRIES = 1500, 2048, 6, 6
#: Half the width in which both children get a vector, as a share of the distance of vectors that just link. A node stays whole if more of it than CROWD lies within.
SPILL, CROWD = 0.05, 0.35
#: Vectors of a stretch of a large leaf.
CELL = 4096
#: Vectors that centres are looked for among, and how many of them a ball needs.
BALL_SAMPLE, BALL_LEAST = 4096, 16
#: Bytes of splits that tasks hold at once; more take further passes over the vectors.
SPLITS_BYTES = 8 << 20
#: Pairs that are looked at together.
PAIRS_AT_ONCE = 1 << 20

VECTOR = "id long, key long, key2 long, w long, x binary, dim int"
NODES = "nodes array<long>, done array<long>"
CLASS = ["id", "key", "key2"]


def unit(table: pa.RecordBatch | pa.Table, dim: int) -> np.ndarray:
    """The vectors in double precision, at length 1."""
    x = b"".join(table.column("x").to_pylist())
    x = np.frombuffer(x, np.float32 if len(x) == 4 * dim * table.num_rows else np.float64).reshape(-1, dim).astype(np.float64)
    x = x / np.abs(x).max(1)[:, None]  # squares of very large or small components stay within range
    return x / np.sqrt((x * x).sum(1))[:, None]


def child(node: int, side: int) -> int:
    return int(mix(np.array([node], np.int64).view(np.uint64) * np.uint64(2) + np.uint64(side)).view(np.int64)[0])


def root(tree: int, dim: int) -> int:
    return child((dim << 16) + tree, 1)


def direction(node: int, turn: int, dim: int) -> np.ndarray:
    """A random unit vector that the node's number gives, wherever it's asked for."""
    r = np.random.default_rng([node & ((1 << 64) - 1), turn]).standard_normal(dim)
    return r / np.sqrt(r @ r)


def keyed(vectors: DataFrame) -> DataFrame:
    """(vec_id, sound, x, key, key2): whether the vector can link, and 128 bits of hash of the components; a zero has no sign."""
    xs = F.transform("embedding", lambda v: F.when(v != 0, v).when(v == 0, F.abs(v)))
    sound = F.col("vec_id").isNotNull() & F.forall(xs, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(xs, lambda v: v != 0)
    return vectors.select("vec_id", F.coalesce(sound, F.lit(False)).alias("sound"), xs.alias("x")).select("*", F.xxhash64("x").alias("key"), F.xxhash64(F.lit(1), "x").alias("key2"))


def classes(vectors: DataFrame) -> DataFrame:
    """VECTOR: a row for each distinct vector that can link, with its smallest id, its hash and the number of rows."""
    rows = keyed(vectors).where("sound").groupBy("key", "key2").agg(F.min(F.col("vec_id").cast("long")).alias("id"), F.count(F.lit(1)).alias("w"), F.any_value("x").alias("x"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = np.float32 if batch.schema.field("x").type.value_type == pa.float32() else np.float64
            xs = [np.asarray(v, kind) for v in batch.column("x").to_pylist()]
            columns = [*(batch.column(c) for c in (*CLASS, "w")), pa.array([x.tobytes() for x in xs], pa.binary()), pa.array([len(x) for x in xs], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, [*CLASS, "w", "x", "dim"])

    return rows.mapInArrow(packed, VECTOR)


def centres(rows: DataFrame, least: float) -> list[tuple[int, np.ndarray]]:
    """Centres of balls, at most BALL_SAMPLE / BALL_LEAST, found among a sample of that size."""
    sample = rows.orderBy("key2", "key").limit(BALL_SAMPLE).select("x", "dim").toArrow()
    near, out = math.cos(math.acos(least) / 2), []
    for dim in sorted(set(sample.column("dim").to_pylist())):
        x = unit(sample.filter(pc.equal(sample.column("dim"), dim)), dim)
        links = x @ x.T >= near
        while len(x) and (n := links.sum(1)).max() >= BALL_LEAST:
            members = links[n.argmax()]
            centre = x[members].mean(0)
            out.append((dim, centre / np.sqrt(centre @ centre)))
            left = ~members & (x @ out[-1][1] < near)
            x, links = x[left], links[np.ix_(left, left)]
    return out


def planted(rows: DataFrame, least: float) -> DataFrame:
    """rows with the number of their ball or null, and the roots of all trees."""
    # the margin keeps rounding from linking a pair that is below least
    found, near = centres(rows, least), math.cos(math.acos(least) / 2) + 1e-9

    def rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            ball = np.full(len(dims), -1, np.int64)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                x = unit(batch.take(pa.array(at)), int(dim))
                for k, (d, c) in enumerate(found):
                    if d == dim:
                        mine = (x @ c >= near) & (ball[at] < 0)
                        ball[at[mine]] = k
            roots = {d: [root(t, int(d)) for t in range(TREES)] for d in np.unique(dims)}
            nodes = pa.array([roots[d] for d in dims], pa.list_(pa.int64()))
            columns = [*batch.columns, pa.array(ball, mask=ball < 0), nodes, pa.array([[]] * len(dims), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "ball", "nodes", "done"])

    return rows.mapInArrow(rooted, f"{VECTOR}, ball long, {NODES}")


def split(node: int, x: np.ndarray, level: int, rows: int, spill: float) -> Iterator[tuple[int, int, float]]:
    """(node, turn of the direction, threshold) of the node and those below it, from a sample x of its rows vectors."""
    if level == LEVELS or rows <= LEAF or len(x) < 8:
        return
    best = None
    for turn in range(TRIES):
        p = np.sort(x @ direction(node, turn, x.shape[1]))
        middle = p[int(len(p) * 0.3) : int(len(p) * 0.7) + 1]
        middle = (middle[1:] + middle[:-1]) / 2
        crowd = (np.searchsorted(p, middle + spill, "right") - np.searchsorted(p, middle - spill)) / len(p)
        k = int(crowd.argmin())
        if best is None or crowd[k] < best[0]:
            best = (crowd[k], turn, middle[k])
    if best[0] > CROWD:
        return
    _, turn, cut = best
    yield node, turn, float(cut)
    p = x @ direction(node, turn, x.shape[1])
    for side, some in enumerate((p <= cut + spill, p >= cut - spill)):
        yield from split(child(node, side), x[some], level + 1, round(rows * some.mean()), spill)


def sent_down(rows: DataFrame, splits: dict[int, tuple[int, float]], tried: set[int], spill: float) -> DataFrame:
    """rows with the nodes that splits or tried name gone down, as far as they lead: to nodes if they may be split further, else to done."""

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            dims, nodes = batch.column("dim").to_numpy(), batch.column("nodes").to_pylist()
            done = batch.column("done").to_pylist()
            stay = [[n for n in ns if n not in tried] for ns in nodes]
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                x = unit(batch.take(pa.array(at)), int(dim))
                queue: dict[int, np.ndarray] = {}
                for k, i in enumerate(at):
                    for n in nodes[i]:
                        if n in tried:
                            queue.setdefault(n, []).append(k)
                tops = set(queue)
                while queue:
                    n, ks = queue.popitem()
                    ks = np.asarray(ks)
                    if n in splits:
                        turn, cut = splits[n]
                        v = known.get((n, dim))
                        if v is None:
                            v = known[n, dim] = direction(n, turn, int(dim))
                        p = x[ks] @ v
                        for side, some in enumerate((p <= cut + spill, p >= cut - spill)):
                            if some.any():
                                queue[child(n, side)] = ks[some]
                    else:
                        for i in at[ks]:
                            (done if n in tops else stay)[i].append(n)
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(stay, kind), pa.array(done, kind)], batch.schema.names)

    return rows.mapInArrow(routed, rows.schema)


def grown(rows: DataFrame, least: float, name: str = "forest") -> DataFrame:
    """planted() rows, sent down round by round until every node is small or can't be split; nodes are all in done then."""
    spark, spill = rows.sparkSession, SPILL * math.sqrt(2 - 2 * least)
    begin, turn = written(), 0
    while True:
        # members of balls are not counted: nothing is gained by splitting them
        sizes = rows.where("ball is null").select(F.explode("nodes").alias("node")).groupBy("node").count().where(F.col("count") > LEAF)
        sizes = saved(sizes, f"{name}-sizes")
        if not sizes.limit(1).count():
            return rows.withColumn("done", F.concat("done", "nodes"))
        share = F.pmod(F.xxhash64("key", "node"), F.lit(1 << 30)) * F.col("count") < F.lit(SAMPLE << 30)
        sample = rows.where("ball is null").select("x", "dim", "key", F.explode("nodes").alias("node")).join(sizes, "node").where(share)

        def fitted(table: pa.Table) -> pa.Table:
            node, dim, count = (table.column(c)[0].as_py() for c in ("node", "dim", "count"))
            made = list(split(node, unit(table, dim), 0, count, spill)) or [(node, -1, 0.0)]
            return pa.Table.from_arrays([pa.array([node] * len(made)), *map(pa.array, zip(*made, strict=True))], ["top", "node", "turn", "cut"])

        fits = saved(sample.groupBy("node").applyInArrow(fitted, "top long, node long, turn long, cut double"), f"{name}-fits")
        passes = -(-fits.count() * 32 // SPLITS_BYTES)
        for k in range(passes):
            held = fits.where(F.pmod(F.xxhash64("top"), F.lit(passes)) == k).collect()
            rows = saved(sent_down(rows, {r.node: (r.turn, r.cut) for r in held if r.turn >= 0}, {r.top for r in held}, spill), f"{name}-{turn}")
            turn += 1
        removed(spark, begin, keep=1)


def first_shared(a: np.ndarray, b: np.ndarray, leaf: int) -> np.ndarray:
    """Whether leaf is the least number that rows of a and b, filled up with the greatest number, share."""
    out = np.ones(len(a), bool)
    for k in range(a.shape[1]):
        lower = out & (a[:, k] < leaf)
        if not lower.any():
            continue
        at = np.flatnonzero(lower)
        out[at[(b[at] == a[at, k][:, None]).any(1)]] = False
    return out


def united(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each one's component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for side in (a, b, label[a], label[b]):
            np.minimum.at(new, side, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def linked(table: pa.Table, least: float) -> pa.Table:
    """A cell of a leaf: (id, key, key2, n, to) with the links that this leaf is the first to know, and a member of its component there that has a smaller id."""
    leaf, i, j = (table.column(c)[0].as_py() for c in ("leaf", "i", "j"))
    table = table.sort_by([("id", "ascending"), ("key", "ascending")])
    x = unit(table, table.column("dim")[0].as_py())
    ids, w, stretch = (table.column(c).to_numpy() for c in ("id", "w", "stretch"))
    ball = table.column("ball").fill_null(-1).to_numpy()
    codes = table.column("done").to_pylist()
    wide = max(map(len, codes))
    codes = np.array([[*c, *[np.iinfo(np.int64).max] * (wide - len(c))] for c in codes], np.int64)
    links, ends = np.zeros(len(ids), np.int64), []
    step = max(1, PAIRS_AT_ONCE // len(ids))
    for at in range(0, len(ids), step):
        close = x[at : at + step] @ x[at:].T >= least
        a, b = np.nonzero(np.triu(close, 1))
        a, b = a + at, b + at
        # two stretches meet here; the pairs within each are another cell's. Those of a ball are known
        some = ((stretch[a] == i) & (stretch[b] == j) | (stretch[a] == j) & (stretch[b] == i)) & ((ball[a] < 0) | (ball[a] != ball[b]))
        a, b = a[some], b[some]
        if len(a):
            new = first_shared(codes[a], codes[b], leaf)
            np.add.at(links, a[new], w[b[new]])
            np.add.at(links, b[new], w[a[new]])
            least_of = united(len(ids), a, b)
            held = np.flatnonzero(least_of != np.arange(len(ids)))
            ends.append((held, least_of[held]))
    a, b = (np.concatenate([e[k] for e in ends]) if ends else np.zeros(0, np.int64) for k in (0, 1))
    to = np.arange(len(ids))
    to = united(len(ids), a, b) if len(a) else to
    out = np.flatnonzero((links > 0) | (to != np.arange(len(ids))))
    return pa.Table.from_arrays([*(pa.array(table.column(c).to_numpy()[out]) for c in CLASS), pa.array(links[out]), pa.array(ids[to[out]])], [*CLASS, "n", "to"])


def compared(rows: DataFrame, least: float) -> DataFrame:
    """(id, key, key2, n, to) of all leaves, see linked()."""
    placed = rows.select(*CLASS, "w", "x", "dim", F.coalesce("ball", F.lit(-1)).alias("ball"), "done", F.explode(F.array_distinct("done")).alias("leaf"))
    sizes = placed.groupBy("leaf", "ball").agg(F.count(F.lit(1)).alias("n"))
    # stretches of a leaf, numbered through its balls and the rest; a leaf of one cell has one stretch for all
    many = F.ceil(F.col("n") / CELL)
    held = sizes.groupBy("leaf").agg(F.sum("n").alias("all"), F.array_sort(F.collect_list(F.struct("ball", many.alias("many")))).alias("groups"))
    held = held.where((F.col("all") > 1) & ~((F.size("groups") == 1) & (F.col("groups")[0]["ball"] >= 0)))
    begin = lambda ball: F.aggregate(F.filter("groups", lambda g: g.ball < ball), F.lit(0).cast("long"), lambda s, g: s + g.many)
    placed = placed.join(held, "leaf")
    whole = F.col("all") <= CELL
    own = F.filter("groups", lambda g: g.ball == F.col("ball"))[0]["many"]
    placed = placed.withColumn("stretch", F.when(whole, 0).otherwise(begin(F.col("ball")) + F.pmod(F.xxhash64("key", "leaf"), own)))
    total = F.aggregate("groups", F.lit(0).cast("long"), lambda s, g: s + g.many)
    # a ball's stretches meet those outside it only
    others = F.filter(F.sequence(F.lit(0).cast("long"), total - 1), lambda s: (F.col("ball") < 0) | (s < begin(F.col("ball"))) | (s >= begin(F.col("ball")) + own))
    cells = F.when(whole, F.array(F.lit(0).cast("long"))).otherwise(others)
    placed = placed.select(*CLASS, "w", "x", "dim", "ball", "done", "leaf", "stretch", F.explode(cells).alias("other"))
    placed = placed.select("*", F.least("stretch", "other").alias("i"), F.greatest("stretch", "other").alias("j")).drop("other")
    return placed.groupBy("leaf", "i", "j").applyInArrow(lambda table: linked(table, least), "id long, key long, key2 long, n long, to long")


def deduplicated(vectors: DataFrame, least: float = LEAST) -> DataFrame:
    """(vec_id, n_links, component_id, kept): a row for each row of vectors."""
    spark: SparkSession = vectors.sparkSession
    own = saved(classes(vectors), "forest-classes")
    begin = written()
    rows = grown(saved(planted(own, least), "forest-roots"), least)
    found = saved(compared(rows, least), "forest-links")
    balls = rows.where("ball is not null").select(*CLASS, "w", "ball")
    heads = balls.groupBy("ball").agg(F.sum("w").alias("all"), F.min("id").alias("to"))
    balls = balls.join(heads, "ball").select(*CLASS, (F.col("all") - F.col("w")).alias("n"), "to")
    ties = saved(found.unionByName(balls).groupBy(*CLASS).agg(F.sum("n").alias("n"), F.collect_set("to").alias("to")), "forest-ties")
    removed(spark, begin, keep=1)
    roots = components(ties.select(F.col("id").alias("a"), F.explode("to").alias("b")), "forest")
    links = ties.select("key", "key2", "n")
    # what each class has, then each row of the table
    has = own.select("id", "key", "key2", "w").join(links, ["key", "key2"], "left").join(roots.withColumnRenamed("node", "id"), "id", "left")
    has = has.select("key", "key2", (F.col("w") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("root", "id").alias("component_id"))
    table = keyed(vectors).drop("x")
    linked = table.where("sound").join(has, ["key", "key2"]).select("vec_id", "n_links", "component_id")
    alone = table.where("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def oracle(least: float = LEAST) -> str:
    """All pairs in DuckDB's SQL."""
    return f"""
WITH RECURSIVE v AS (SELECT row_number() OVER () AS k, vec_id, embedding::DOUBLE[] AS x FROM embeddings),
s AS (SELECT * FROM v WHERE vec_id IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda a: a IS NULL OR NOT isfinite(a))) = 0 AND len(list_filter(x, lambda a: a <> 0)) > 0),
l AS (SELECT a.k AS a, b.k AS b, a.vec_id AS p, b.vec_id AS q FROM s a JOIN s b ON a.k <> b.k AND CASE WHEN len(a.x) = len(b.x) THEN list_cosine_similarity(a.x, b.x) END >= {least}),
r(p, q) AS (SELECT DISTINCT vec_id, vec_id FROM v WHERE vec_id IS NOT NULL UNION SELECT r.p, l.q FROM r JOIN l ON l.p = r.q),
c AS (SELECT p, min(q) AS component_id FROM r GROUP BY p),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM v LEFT JOIN n ON n.a = v.k LEFT JOIN c ON c.p = v.vec_id
"""
