"""Conversation prefix trie by family-first merging.

A family is the conversations of one base id, c - c % 5 (as SQL's %). Of the texts only digests and lengths travel. They are laid out in ranges of (conversation,
turn), so that a conversation of any length is numbered, and hashed prefix by prefix, by several tasks. The first turns of a base and of its
family's conversations are cogrouped; each family's small trie is built there, and its nodes, each with the members it has in the family, go into the
global merge. Turns after the first NEAR of a conversation become nodes of their own range by range, by the prefix hash that the family hands them.

A prefix of d turns is known by d and two sums over its turns of digest * R ** place, modulo 2 ** 64 (128 bits of the turns' SHA-256): a sum goes on
from any place, so ranges and swapped beginnings need no second pass over the turns.

Sums over subtrees take no walk over levels: among the nodes, a conversation owns those of which it is the smallest member, a run of its path down
to its end. What the runs of all members of a node add up to, less what the node's own run has above it, is the sum over its subtree.

Order within a conversation: turn, null first; equal turns by the SHA-256 of role and text; repeated rows are turns like others. Null role and text
count as empty. Rows without conv_id belong to no conversation and are left out. Empty texts are turns; texts of any length are only digested.
No conversations: no nodes, not even the root. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from assertlake.llm.common import parts, removed, saved, written

FAMILY = 5
#: The beginning of a base that a conversation takes over is at most so long, less one.
HEADS = 9
#: Turns of a conversation that its family's trie holds; the others become nodes in their ranges.
NEAR = 64
#: Ids of ends that one row holds, as a power of two; depths that one window runs over.
ENDS_BITS, DEPTHS = 10, 4096

R = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1

LAID = "part int, conv_id long, i long, a long, b long, f long, g long, bytes long, first boolean, total boolean"
TRIE = "kind int, depth long, f long, g long, pf long, pg long, bytes long, members array<long>, ends array<long>"


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def power(e: np.ndarray) -> np.ndarray:
    """R ** e modulo 2 ** 64, also for e < 0."""
    e = e.astype(np.int64) % (1 << 62)  # the order of R divides it
    out, square, left = np.ones(len(e), np.uint64), np.full(1, R, np.uint64), e.astype(np.uint64)
    while left.any():
        out = np.where(left & np.uint64(1), out * square, out)
        square, left = square * square, left >> np.uint64(1)
    return out


def column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def lanes(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [column(batch, n).astype(np.int64).view(np.uint64) for n in names]


def base(conv_id: Column) -> Column:
    return conv_id - conv_id % FAMILY


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, bytes)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    return conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))


def laid(rows: DataFrame) -> DataFrame:
    """turns() in ranges -> LAID: i is the place in the conversation, f and g the prefix sums, both within the task; first marks the rows of a
    task's first conversation, which may begin before it. A total row (i: count, f, g: sums) closes the first and the last one of a task."""
    keys = ["conv_id", "turn", "digest"]
    spread = rows.repartitionByRange(parts(rows.sparkSession, rows), *keys).sortWithinPartitions(*keys)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, names = TaskContext.get().partitionId(), [c.split()[0] for c in LAID.split(", ")]
        opening, now, count, sums = None, None, 0, [0, 0]

        def out(conv, i, a, b, f, g, size, first, total):
            n, signs = len(conv), [np.asarray(x, np.uint64).view(np.int64) for x in (a, b, f, g)]
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array(conv), pa.array(i), *map(pa.array, signs), pa.array(size), pa.array(first), pa.array(np.full(n, total))], names)

        def closed():
            one = lambda x: np.array([x], np.int64)
            return out(one(now), one(count), [0], [0], [sums[0]], [sums[1]], one(0), np.array([now == opening]), True)

        for batch in batches:
            if not batch.num_rows:
                continue
            conv, size = column(batch, "conv_id"), column(batch, "bytes")
            n = len(conv)
            digest = batch.column("digest").cast(pa.large_binary())
            begin = np.frombuffer(digest.buffers()[1], np.int64)[digest.offset]
            a, b = np.frombuffer(digest.buffers()[2], np.uint8)[begin : begin + 32 * n].reshape(n, 32)[:, :16].copy().view("<u8").T
            if opening is None:
                opening = now = int(conv[0])
            elif conv[0] != now and now == opening:
                yield closed()
            start = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
            length = np.diff(np.concatenate([start, [n]]))
            carried = conv[0] == now
            i = np.arange(n) - np.repeat(start, length) + 1
            if carried:
                i[: length[0]] += count
            step, sum_to = power(i), []
            for lane, old in zip((a, b), sums, strict=True):
                total = np.cumsum(lane * step, dtype=np.uint64)
                before = np.where(start > 0, total[start - 1], np.uint64(0))
                if carried:
                    before[0] -= np.uint64(old)
                sum_to.append(total - np.repeat(before, length))
            yield out(conv, i, a, b, *sum_to, size, conv == opening, False)
            if conv[0] == opening != conv[-1]:  # the first one ends within the batch
                now, count, sums = opening, int(i[length[0] - 1]), [int(x[length[0] - 1]) for x in sum_to]
                yield closed()
            now, count, sums = int(conv[-1]), int(i[-1]), [int(x[-1]) for x in sum_to]
        if opening is not None:
            yield closed()

    return spread.mapInArrow(numbered, LAID)


def offsets(laid: DataFrame) -> DataFrame:
    """(conv_id, part, n, sf, sg) of what earlier parts have of a part's first conversation; at most two rows of a part are looked at."""

    def added(table: pa.Table) -> pa.Table:
        out, n, f, g = [], 0, 0, 0
        for row in sorted(table.to_pylist(), key=lambda r: r["part"]):
            if n:
                out.append((row["conv_id"], row["part"], n, signed(f), signed(g)))
            step = pow(R, n, 1 << 64)
            n, f, g = n + row["i"], (f + row["f"] * step) & MASK, (g + row["g"] * step) & MASK
        return pa.Table.from_arrays([pa.array([r[k] for r in out], pa.int32() if k == 1 else pa.int64()) for k in range(5)], ["conv_id", "part", "n", "sf", "sg"])

    return laid.where("total").groupBy("conv_id").applyInArrow(added, "conv_id long, part int, n long, sf long, sg long")


def placed(laid: DataFrame) -> DataFrame:
    """(conv_id, i, a, b, f, g, bytes) with places and sums of the whole conversation."""
    columns = ["conv_id", "i", "a", "b", "f", "g", "bytes"]
    rows = laid.where("not total")

    def shifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, step = column(batch, "n"), power(column(batch, "n"))
            f, g, sf, sg = lanes(batch, "f", "g", "sf", "sg")
            new = {"i": column(batch, "i") + n, "f": (sf + f * step).view(np.int64), "g": (sg + g * step).view(np.int64)}
            yield pa.RecordBatch.from_arrays([pa.array(new[c]) if c in new else batch.column(c) for c in columns], columns)

    first = rows.where("first").join(offsets(laid), ["conv_id", "part"], "left")
    late = first.where("n is not null").mapInArrow(shifted, ", ".join(f"{c} long" for c in columns))
    return rows.where("not first").select(*columns).unionByName(first.where("n is null").select(*columns)).unionByName(late)


def family_trie(heads: pa.Table, convs: pa.Table) -> pa.Table:
    """The first HEADS - 1 turns of a base, and (conv_id, n, near) of each conversation of its family -> its trie (kind 0: nodes with members and ends), and
    for conversations with turns beyond NEAR how their hashes go on (kind 1: depth is what to add to a place, f and g what to add to a sum)."""
    head = sorted((t for row in heads.to_pylist() for t in row["near"]), key=lambda t: t["i"])[: HEADS - 1]
    trie: dict[tuple, list] = {}
    rows = []
    for conv in sorted(convs.to_pylist(), key=lambda c: c["conv_id"]):
        c = conv["conv_id"]
        h = zlib.crc32(str(c).encode()) % HEADS
        kept, own = head[:h], sorted(conv["near"], key=lambda t: t["i"])
        parent, at = None, (0, 0, 0)
        path = [None, *kept, *own[h:]]
        for depth, turn in enumerate(path):
            if turn is not None:
                step = pow(R, depth, 1 << 64)
                parent, at = at, (depth, (at[1] + turn["a"] * step) & MASK, (at[2] + turn["b"] * step) & MASK)
            node = trie.setdefault(at, [parent, turn["bytes"] if turn else 0, [], []])
            node[2].append(c)
        if conv["n"] <= NEAR:
            node[3].append(c)
        else:
            cut = own[:h]
            less = [sum(t[x] * pow(R, t["i"], 1 << 64) for t in cut) * pow(R, len(kept) - h, 1 << 64) for x in ("a", "b")]
            have = [sum(t[x] * pow(R, k, 1 << 64) for k, t in enumerate(kept, 1)) for x in ("a", "b")]
            rows.append((1, len(kept) - h, *(signed((x - y) & MASK) for x, y in zip(have, less, strict=True)), None, None, 0, [c], []))
    rows += [(0, d, signed(f), signed(g), *((signed(parent[1]), signed(parent[2])) if parent else (None, None)), size, members, ends) for (d, f, g), (parent, size, members, ends) in trie.items()]
    kinds = [pa.int32(), *[pa.int64()] * 6, pa.list_(pa.int64()), pa.list_(pa.int64())]
    return pa.Table.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], [c.split()[0] for c in TRIE.split(", ")])


def family_nodes(rows: DataFrame) -> DataFrame:
    """placed() -> TRIE: the nodes of the families' tries, with the nodes of long conversations' other turns; kind 1 rows are used up."""
    near = rows.groupBy("conv_id").agg(F.max("i").alias("n"), F.collect_list(F.when(F.col("i") <= NEAR, F.struct("i", "a", "b", "bytes"))).alias("near"))
    near = near.withColumn("base", base(F.col("conv_id")))
    heads = near.where("conv_id = base").select(F.col("base").alias("of"), F.filter("near", lambda t: t.i < HEADS).alias("near"))
    families = saved(heads.groupBy("of").cogroup(near.groupBy("base")).applyInArrow(family_trie, TRIE), "trie-families")
    on = families.where("kind = 1").select(F.col("members")[0].alias("conv_id"), F.col("depth").alias("shift"), F.col("f").alias("af"), F.col("g").alias("ag"))
    far = rows.where(F.col("i") > NEAR).join(on, "conv_id").join(near.where(F.col("n") > NEAR).select("conv_id", "n"), "conv_id")

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            conv, i, shift, n, size = (column(batch, c) for c in ("conv_id", "i", "shift", "n", "bytes"))
            step, on = power(i), power(shift)
            own, before = [], []
            for lane, total, add in (("a", "f", "af"), ("b", "g", "ag")):
                lane, total, add = lanes(batch, lane, total, add)
                own.append(pa.array((add + total * on).view(np.int64)))
                before.append(pa.array((add + (total - lane * step) * on).view(np.int64)))
            each = np.arange(len(conv) + 1, dtype=np.int32)
            ended = np.concatenate([[0], np.cumsum(i == n)]).astype(np.int32)
            members, ends = pa.ListArray.from_arrays(each, conv), pa.ListArray.from_arrays(ended, conv[i == n])
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(conv), np.int32)), pa.array(i + shift), *own, *before, pa.array(size), members, ends], [c.split()[0] for c in TRIE.split(", ")])

    return families.where("kind = 0").unionByName(far.mapInArrow(reached, TRIE))


NODE = ["depth", "f", "g"]


def hashed_ends(trie: DataFrame) -> DataFrame:
    """(depth, f, g, ends_sha256) of nodes where conversations end. Ids come in rows of a few, sorted, and run through one hash a node."""
    ends = trie.where(F.size("ends") > 0).select(*NODE, F.explode("ends").alias("c"))
    chunks = ends.groupBy(*NODE, F.shiftright("c", ENDS_BITS).alias("at")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda c: c.cast("string")), ",").alias("ids"))
    schema = ", ".join(f"{c} long" for c in NODE) + ", ends_sha256 string"

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, hasher, done = None, None, []

        def out():
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], pa.string() if k == 3 else pa.int64()) for k in range(4)], [*NODE, "ends_sha256"])

        for batch in batches:
            for *node, ids in zip(*(batch.column(c).to_pylist() for c in (*NODE, "ids")), strict=True):
                if node == now:
                    hasher.update(b"," + ids.encode())
                else:
                    if now:
                        done.append((*now, hasher.hexdigest()))
                    now, hasher = node, hashlib.sha256(ids.encode())
            yield out()
            done = []
        if now:
            done.append((*now, hasher.hexdigest()))
            yield out()

    return chunks.repartition(*NODE).sortWithinPartitions(*NODE, "at").select(*NODE, "ids").mapInArrow(digests, schema)


def merged(trie: DataFrame) -> DataFrame:
    """The global merge: a row for each node, with its measures."""
    nodes = trie.groupBy(*NODE).agg(
        F.sum(F.size("members")).alias("n_convs"), F.min(F.array_min("members")).alias("conv_id"), F.max("bytes").alias("bytes"), F.max(F.struct("pf", "pg")).alias("up"),
    )
    nodes = saved(nodes.select(*NODE, "n_convs", "conv_id", "bytes", "up.pf", "up.pg"), "trie-nodes")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pf").alias("f"), F.col("pg").alias("g")).agg(F.count(F.lit(1)).alias("n_children"))
    worth = (F.col("n_convs") - 1) * F.col("bytes")
    rows = saved(nodes.join(children, NODE, "left").withColumns({"n_children": F.coalesce("n_children", F.lit(0)), "worth": worth, "run": F.floor(F.col("depth") / DEPTHS)}), "trie-rows")
    # what each conversation's own run adds up to, and whether a leaf ends it
    owners = rows.groupBy("conv_id").agg(F.sum("worth").alias("worth"), F.count_if(F.col("n_children") == 0).alias("leaf")).where("worth > 0 or leaf > 0")
    below = trie.select(*NODE, F.explode("members").alias("conv_id")).join(owners, "conv_id").groupBy(*NODE).agg(F.sum("worth").alias("below"), F.sum("leaf").alias("n_leaves"))
    # what a run has above a node: of its stretch of DEPTHS, and of the stretches before
    earlier = (W.unboundedPreceding, -1)
    stretches = rows.groupBy("conv_id", "run").agg(F.sum("worth").alias("worth"))
    stretches = stretches.select("conv_id", "run", F.sum("worth").over(W.partitionBy("conv_id").orderBy("run").rowsBetween(*earlier)).alias("before")).where("before > 0")
    inside = F.sum("worth").over(W.partitionBy("conv_id", "run").orderBy("depth").rowsBetween(*earlier))
    rows = rows.withColumn("inside", inside).join(stretches, ["conv_id", "run"], "left")
    above = F.coalesce("inside", F.lit(0)) + F.coalesce("before", F.lit(0))
    ups = nodes.select((F.col("depth") + 1).alias("depth"), F.col("f").alias("pf"), F.col("g").alias("pg"), F.col("conv_id").alias("parent_conv_id"))
    rows = rows.join(below, NODE, "left").join(ups, ["depth", "pf", "pg"], "left").join(hashed_ends(trie), NODE, "left")
    return rows.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", (F.col("below") - above).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


def trie(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): a row for each node."""
    begin = written()
    rows = saved(laid(saved(turns(conversations), "trie-turns")), "trie-laid")
    nodes = saved(family_nodes(placed(rows)), "trie-members")
    removed(conversations.sparkSession, begin, keep=1)
    return merged(nodes)


def oracle() -> str:
    """The same in DuckDB's SQL, with each node's prefix spelt out; crc32 goes byte by byte over a table made from its polynomial."""
    return f"""
WITH poly AS (SELECT list(list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b::BIGINT) ORDER BY b) AS t FROM range(0, 256) AS x(b)),
d AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT conv_id, turn, strlen(text) AS bytes, sha256(strlen(role)::VARCHAR || ':' || role || text) AS digest FROM d),
o AS (SELECT conv_id, bytes, digest, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS i FROM t),
c AS (
  SELECT conv_id, conv_id - conv_id % {FAMILY} AS base, xor(list_reduce(list_transform(range(0, strlen(conv_id::VARCHAR)), lambda i: ('0x' || substr(hex(encode(conv_id::VARCHAR)), 2 * i + 1, 2))::BIGINT),
    lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]), 4294967295), 4294967295) % {HEADS} AS h FROM (SELECT DISTINCT conv_id FROM o), poly),
r AS (
  SELECT c.conv_id, 0 AS side, i, bytes, digest FROM c JOIN o ON o.conv_id = c.base AND i <= h
  UNION ALL SELECT c.conv_id, 1, i, bytes, digest FROM c JOIN o ON o.conv_id = c.conv_id AND i > h),
s AS (SELECT conv_id, bytes, digest, row_number() OVER (PARTITION BY conv_id ORDER BY side, i) AS depth FROM r),
e AS (
  SELECT conv_id, 0 AS depth, 0 AS bytes, '' AS prefix FROM c
  UNION ALL SELECT conv_id, depth, bytes, sha256(string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY depth)) FROM s),
l AS (SELECT conv_id, max(depth) AS depth FROM e GROUP BY conv_id),
m AS (
  SELECT e.depth, prefix, min(e.conv_id) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes,
    sha256(coalesce(string_agg(e.conv_id::VARCHAR, ',' ORDER BY e.conv_id) FILTER (e.depth = l.depth), '')) AS ends_sha256 FROM e JOIN l USING (conv_id) GROUP BY e.depth, prefix),
u AS (SELECT m.*, p.prefix AS up FROM m LEFT JOIN e p ON p.conv_id = m.conv_id AND p.depth = m.depth - 1),
k AS (SELECT depth - 1 AS depth, up AS prefix, count(*) AS n_children FROM u WHERE depth > 0 GROUP BY depth, up),
v AS (SELECT u.*, coalesce(n_children, 0) AS n_children FROM u LEFT JOIN k USING (depth, prefix)),
b AS (SELECT a.depth, a.prefix, sum((v.n_convs - 1) * v.bytes)::BIGINT AS saved_tokens, count(*) FILTER (v.n_children = 0) AS n_leaves FROM v JOIN e a ON a.conv_id = v.conv_id AND a.depth <= v.depth GROUP BY a.depth, a.prefix)
SELECT v.conv_id, v.depth, w.conv_id AS parent_conv_id, v.n_convs, v.n_children, n_leaves, saved_tokens, v.ends_sha256
FROM v JOIN b USING (depth, prefix) LEFT JOIN v w ON w.depth = v.depth - 1 AND w.prefix = v.up
"""
