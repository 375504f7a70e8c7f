"""N-gram Jaccard join: which texts share most of their word shingles, by signature trees.

A document's set holds the hashes of its distinct SHINGLE-word shingles. Documents with equal sets are one class. Two classes are linked
when 100 * |A & B| >= 80 * |A | B|. The way there loses no link:

1. Order. Each shingle gets a level by the frequency of its rarest word (words with at least WORD_SHARE of all words are counted; there are at
   most 1 / WORD_SHARE of them, so their table has a bound). Sets are sorted by (level, hash), the rarest first.
2. Prefixes. Two sets that reach the threshold share one of their first n - ceil(0.8 n) + 1 shingles. These go, in blocks for each range of
   hashes, to tasks that find the groups of classes which share one; equal groups count once.
3. Trees. A group's token bitmaps meet in one task, which builds a signature tree: nodes hold the OR of bitmaps and a range of sizes. A dual
   traversal drops node pairs whose greatest possible overlap or sizes can't reach the threshold, and those that are tied already; what is
   left is tied: a forest of ties, not pairs.
4. Components of ties hold all links. Their sets meet in one task, in the same way, where the leaves compare sets exactly.
5. The links' components, over classes, give each document its component.

A group of over CHUNK classes is dealt to chunks twice, by two hashes, so each class is sent twice; copies of one text come together by that. Only
if the group still has several components are those compared with each other: by bands of size, which linked sets can't skip, and
in a band by pairs of chunks, with what has one component passed over.

Sets are of 59-bit hashes and 5 bits of level; classes are 64-bit hashes of sets.

Null, empty or word-free text: an empty set, linked with nothing, its own component. Fewer than SHINGLE words: one shingle, the whole.
Repeated rows or ids: each gives a row; equal texts are one class. Null doc_id: counts as no id when the smallest is taken. Empty table: no
rows. Other columns, whatever their names, are passed on by one_of_each() and ignored by the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from assertlake.llm.common import LOWER, SPACED, Words, fresh, mix, ngram_hashes, parts, ranges, saved, settled, slices
from assertlake.llm.graph import components

SHINGLE = 5
WORD_SHARE = 2e-6
CHUNK = 4096
LEAF, FAN_OUT = 16, 8
#: Linked sets are at most one band of sizes apart: 1.25 is the greatest ratio of their sizes.
BAND = 1.26
#: A class with over 1 / HOT_CLASSES of all rows is hot; so there are fewer than so many.
HOT_CLASSES = 2000


def enough(shared: int, n: int, m: int) -> bool:
    return 100 * shared >= 80 * (n + m - shared)


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash, count) of the words that have a quarter of WORD_SHARE of this task's words; hash null: the number of all."""
    held, counts, total = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
    fresh: list[np.ndarray] = []
    n_fresh = 0

    def fold() -> None:
        nonlocal held, counts, fresh, n_fresh
        new, n = np.unique(np.concatenate(fresh), return_counts=True) if fresh else (held[:0], counts[:0])
        both, at = np.unique(np.concatenate([held, new]), return_inverse=True)
        counts = np.bincount(at, np.concatenate([counts, n]), len(both)).astype(np.int64)
        held, fresh, n_fresh = both, [], 0

    for batch in batches:
        for _, _, data, offsets in slices(batch.column(0)):
            h = Words(LOWER[data], offsets, SPACED).hashes()
            fresh.append(h)
            n_fresh += len(h)
            total += len(h)
            if n_fresh > 1_000_000:
                fold()
    fold()
    on = counts >= max(2, WORD_SHARE / 4 * total)
    yield pa.RecordBatch.from_arrays([pa.array([*held[on].view(np.int64).tolist(), None], pa.int64()), pa.array([*counts[on].tolist(), total], pa.int64())], ["h", "n"])


def word_levels(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of frequent words and their levels, 1 to 31: more frequent is higher."""
    rows = saved(docs.select("text").mapInArrow(settled(_frequent), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "signature-words")
    total = sum(r.n for r in rows.where("h is null").collect()) or 1
    least = max(2, WORD_SHARE * total)
    found = rows.where((F.col("h").isNotNull()) & (F.col("n") >= least)).toPandas()
    h = found["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    level = np.clip(np.log2(found["n"].to_numpy(np.float64) / least), 0, 30).astype(np.uint64) + np.uint64(1)
    return h[order], level[order]


def sets(data: np.ndarray, offsets: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """The sorted set of each text."""
    words = Words(LOWER[data], offsets, SPACED)
    h = words.hashes()
    table, levels = frequent
    level = np.zeros(len(h), np.uint64)
    if len(table) and len(h):
        at = np.minimum(np.searchsorted(table, h), len(table) - 1)
        level = np.where(table[at] == h, levels[at], np.uint64(0))
    grams = ngram_hashes(h, SHINGLE)
    low = level[: len(grams)].copy()
    for i in range(1, SHINGLE):
        np.minimum(low, level[i : i + len(grams)], out=low)
    keys = (grams >> np.uint64(5)) | (low << np.uint64(59))
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= SHINGLE:
            s = np.sort(keys[a : b - SHINGLE + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif b > a:
            out.append(mix(ngram_hashes(h[a:b], b - a) + np.uint64(b - a)) >> np.uint64(5))
        else:
            out.append(keys[:0])
    return out


def class_of(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes(), len(s)) - (1 << 63)


ROWS = "doc_id long, t long, n_shingles long, class long, bitmap binary, part int, tokens binary, classes binary"


def bits_of(n: int) -> int:
    """The size of a bitmap for n shingles; half as large a set has half as large a bitmap."""
    return min(1 << max(8, (2 * n - 1).bit_length()), 1 << 16)


def bitmap(s: np.ndarray, bits: int) -> np.ndarray:
    full = np.zeros(bits, bool)
    full[(mix(s) % np.uint64(bits)).astype(np.int64)] = True
    return np.packbits(full)


def _prefixes(n_parts: int, frequent: tuple[np.ndarray, np.ndarray]):
    """A row for each document, and blocks (part, tokens, classes) of the prefixes of its classes."""

    def blocks(tokens: list, owners: list) -> pa.RecordBatch:
        token, owner = np.concatenate(tokens), np.repeat(np.array([x for x, _ in owners], np.int64), [n for _, n in owners])
        part = (mix(token) % np.uint64(n_parts)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        token, owner, part = token[order], owner[order], part[order]
        cut = np.searchsorted(part, np.arange(n_parts + 1))
        on = [p for p in range(n_parts) if cut[p] < cut[p + 1]]
        none = pa.nulls(len(on), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, none, none, pa.nulls(len(on), pa.binary()), pa.array(on, pa.int32()), *(pa.array([x[cut[p] : cut[p + 1]].tobytes() for p in on], pa.binary()) for x in (token, owner))], names)

    names = [x.split()[0] for x in ROWS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, owners, held = [], [], 0
        seen: set[int] = set()
        for batch in batches:
            for i, j, data, offsets in slices(batch.column("text")):
                own = sets(data, offsets, frequent)
                classes = [class_of(s) if len(s) else None for s in own]
                maps: list[bytes | None] = []
                for s, c in zip(own, classes):
                    if c is None or c in seen:
                        maps.append(None)
                        continue
                    seen.add(c)
                    maps.append(bitmap(s, bits_of(len(s))).tobytes())
                    n = len(s) - (4 * len(s) + 4) // 5 + 1
                    tokens.append(s[:n].copy())
                    owners.append((c, n))
                    held += n
                none = j - i
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), batch.column("t").slice(i, j - i), pa.array([len(s) for s in own], pa.int64()), pa.array(classes, pa.int64()), pa.array(maps, pa.binary()), pa.nulls(none, pa.int32()), pa.nulls(none, pa.binary()), pa.nulls(none, pa.binary())], names)
                if len(seen) > 1_000_000:
                    seen.clear()
                if held > 500_000:
                    yield blocks(tokens, owners)
                    tokens, owners, held = [], [], 0
        if held:
            yield blocks(tokens, owners)

    return run


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(group, class) for the groups of classes that share a token; a part's blocks are all in one task. A group is known by its members."""
    tokens: dict[int, list] = {}
    classes: dict[int, list] = {}
    for batch in batches:
        for p, t, c in zip(*(batch.column(x).to_pylist() for x in ("part", "tokens", "classes"))):
            tokens.setdefault(p, []).append(np.frombuffer(t, np.uint64))
            classes.setdefault(p, []).append(np.frombuffer(c, np.int64))
    for p in list(tokens):
        token, owner = np.concatenate(tokens.pop(p)), np.concatenate(classes.pop(p))
        order = np.lexsort((owner, token))
        token, owner = token[order], owner[order]
        once = np.concatenate([[True], (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])])
        token, owner = token[once], owner[once]
        first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        size = np.diff(np.append(first, len(token)))
        members = np.add.reduceat(mix(owner.view(np.uint64)), first)
        known, at = np.unique(mix(members + size.astype(np.uint64)), return_index=True)
        many = size[at] > 1
        known, at = known[many], at[many]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(known.view(np.int64), size[at])), pa.array(owner[ranges(first[at], size[at])])], ["group", "class"])


class Forest:
    """Union-find over names; the smallest is the root."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def unite(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)

    def links(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(self.up), pa.int64()), pa.array([self.find(x) for x in self.up], pa.int64())], ["a", "b"])


class SignatureTree:
    """Levels of nodes over sets in the order of their sizes: OR of bitmaps, least and greatest size, greatest excess of a size over its bitmap."""

    def __init__(self, maps: np.ndarray, size: np.ndarray):
        self.bitmap, self.size = maps, size
        self.excess = size - np.bitwise_count(maps).sum(1)
        self.levels = [self._level(maps, size, size, self.excess, np.arange(0, len(maps), LEAF))]
        while len(self.levels[-1][0]) > 1:
            below = self.levels[-1]
            self.levels.append(self._level(*below, np.arange(0, len(below[0]), FAN_OUT)))

    @staticmethod
    def _level(maps, low, high, excess, firsts):
        return np.bitwise_or.reduceat(maps, firsts), np.minimum.reduceat(low, firsts), np.maximum.reduceat(high, firsts), np.maximum.reduceat(excess, firsts)

    @staticmethod
    def possible(nodes: tuple, i: int, js: np.ndarray) -> np.ndarray:
        """Which of the nodes js may hold a partner of a set in node i: sizes within the threshold, and overlap enough."""
        maps, low, high, excess = nodes
        fits = (5 * high[i] >= 4 * low[js]) & (5 * high[js] >= 4 * low[i])
        overlap = np.bitwise_count(maps[js] & maps[i]).sum(1) + np.minimum(excess[js], excess[i])
        return fits & (9 * overlap >= 4 * (low[i] + low[js]))

    def traverse(self, names: list[int], tied: Forest, confirm) -> None:
        """Ties the names of all pairs that may reach the threshold and that confirm(i, j) accepts, unless they are tied already."""
        n = len(names)
        sets = (self.bitmap, self.size, self.size, self.excess)
        open_ = [(len(self.levels) - 1, 0, 0)]
        while open_:
            level, i, j = open_.pop()
            width, nodes = (FAN_OUT, self.levels[level - 1]) if level else (LEAF, sets)
            count = len(nodes[0])
            right = np.arange(j * width, min(count, (j + 1) * width))
            for a in range(i * width, min(count, (i + 1) * width)):
                to = right[right >= a + (level == 0)] if i == j else right
                if not level and len(to):
                    own = tied.find(names[a])
                    to = to[[tied.find(names[b]) != own for b in to.tolist()]]
                if not len(to):
                    continue
                for b in to[self.possible(nodes, a, to)].tolist():
                    if level:
                        open_.append((level - 1, a, b))
                    elif tied.find(names[a]) != tied.find(names[b]) and confirm(a, b):
                        tied.unite(names[a], names[b])


def fold(maps: list[np.ndarray], bits: int) -> np.ndarray:
    """Bitmaps of bits or a multiple of them, as rows of 64-bit words for bits."""
    return np.stack([np.bitwise_or.reduce(m.reshape(-1, bits // 8), axis=0) for m in maps]).view(np.uint64)


def tie_group(names: list[int], sizes: list[int], maps: list[np.ndarray], tied: Forest) -> None:
    """Ties the members of a group that may be linked. Bitmaps are compared at the size that the smaller set has; no linked set has over twice that."""
    order = sorted(range(len(names)), key=lambda i: (sizes[i], names[i]))
    names, sizes, maps = ([x[i] for i in order] for x in (names, sizes, maps))
    bits = np.array([8 * len(m) for m in maps])
    for own in np.unique(bits):
        on = np.flatnonzero((bits == own) | (bits == 2 * own))
        if len(on) > 1 and len({tied.find(names[i]) for i in on.tolist()}) > 1:
            tree = SignatureTree(fold([maps[i] for i in on.tolist()], int(own)), np.array([sizes[i] for i in on.tolist()]))
            mine = bits[on] == own
            tree.traverse([names[i] for i in on.tolist()], tied, lambda a, b, mine=mine: bool(mine[a] or mine[b]))


def _by_task(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[dict]:
    """class -> (name, n, the column), for each task; rows come sorted by task, and a class that comes again is skipped."""
    task, held = None, {}
    for batch in batches:
        for i in range(0, batch.num_rows, 500):
            part = batch.slice(i, 500)
            for t, c, *row in zip(*(part.column(k).to_pylist() for k in ("task", "class", "name", "n", column))):
                if t != task and held:
                    yield held
                    held = {}
                task = t
                held.setdefault(c, row)
    if held:
        yield held


def _ties(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (task, class, name, n, bitmap) sorted by task -> a forest of ties between names."""
    tied = Forest()
    for own in _by_task(batches, "bitmap"):
        names, sizes, maps = zip(*own.values())
        if len(set(names)) > 1:
            tie_group(list(names), list(sizes), [np.frombuffer(m, np.uint8) for m in maps], tied)
        if len(tied.up) > 1_000_000:
            yield tied.links()
            tied = Forest()
    yield tied.links()


def link_sets(members: list[np.ndarray], names: list[int]) -> Forest:
    """Ties the names of linked members, which are not empty; those of one name are tied already."""
    order = sorted(range(len(members)), key=lambda i: (len(members[i]), i))
    own = [members[i] for i in order]
    named = [names[i] for i in order]
    tied = Forest()

    def linked(a: int, b: int) -> bool:
        s, t = own[a], own[b]
        at = np.searchsorted(t, s)
        at[at == len(t)] = 0
        return enough(int(np.count_nonzero(t[at] == s)), len(s), len(t))

    if len(own) <= 3:
        for b in range(len(own)):
            for a in range(b):
                if tied.find(named[a]) != tied.find(named[b]) and 5 * len(own[a]) >= 4 * len(own[b]) and linked(a, b):
                    tied.unite(named[a], named[b])
    else:
        bits = bits_of(len(own[-1]))
        tree = SignatureTree(np.stack([bitmap(s, bits) for s in own]).view(np.uint64), np.array([len(s) for s in own]))
        tree.traverse(named, tied, linked)
    return tied


def _linked(frequent: tuple[np.ndarray, np.ndarray]):
    """Rows (task, class, name, n, text) sorted by task -> a forest of links between names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _by_task(batches, "text"):
            names, _, texts = zip(*own.values())
            if len(set(names)) > 1:
                members = [s for _, _, data, offsets in slices(pa.array(texts, pa.string())) for s in sets(data, offsets, frequent)]
                tied = link_sets(members, list(names))
                if tied.up:
                    yield tied.links()

    return run


def chunked(members: DataFrame, group: list[str], chunk: int) -> DataFrame:
    """Adds chunks to rows of groups: how many chunks the group has."""
    return members.join(members.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("chunks")), group)


def grouped_components(members: DataFrame, attach, judge, n_parts: int, chunk: int, name: str) -> DataFrame:
    """(class, root) of the classes that judge ties within the groups of rows (group, class, n). attach adds to rows (task, class, name, n) the
    column that judge compares."""
    run = lambda rows: attach(rows).repartition(n_parts, "task").sortWithinPartitions("task").mapInArrow(settled(judge), "a long, b long")
    of = lambda seed: F.pmod(F.xxhash64("class", F.lit(seed)), F.col("chunks")).cast("int")
    rows = chunked(members, ["group"], chunk)
    twice = F.when(F.col("chunks") > 1, F.array(*(F.concat_ws("-", "group", F.lit(str(k)), of(k)) for k in (1, 2)))).otherwise(F.array(F.col("group").cast("string")))
    found = components(run(rows.select(F.explode(twice).alias("task"), "class", F.col("class").alias("name"), "n")), name).withColumnRenamed("node", "class")
    large = rows.where("chunks > 1").join(found, "class", "left").select("group", "class", "n", F.coalesce("root", "class").alias("name"))
    several = large.groupBy("group").agg(F.min("name").alias("low"), F.max("name").alias("high")).where("low <> high").select("group")
    large = saved(large.join(several, "group"), f"{name}-large")
    if large.isEmpty():
        return found
    band = F.floor(F.log(F.col("n")) / F.log(F.lit(BAND))).cast("int")
    rest = chunked(large.select("group", F.explode(F.array(band, band + 1)).alias("band"), "class", "name", "n"), ["group", "band"], chunk)
    own = of(3)
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda i: F.concat_ws("-", "group", "band", F.least(i, own), F.greatest(i, own)))
    more = components(run(rest.select(F.explode(pairs).alias("task"), "class", "name", "n")), f"{name}-rest").select(F.col("node").alias("root"), F.col("root").alias("low"))
    both = found.union(large.select("class", F.col("name").alias("root"))).distinct()
    return both.join(more, "root", "left").select("class", F.coalesce("low", "root").alias("root"))


def identified(docs: DataFrame, names: list[str]) -> DataFrame:
    """docs with the columns names: whether the id is null, the id (0 for null), a hash of the text."""
    none, doc, t = names
    id_ = F.col("doc_id").cast("long")
    return docs.select("*", id_.isNull().alias(none), F.coalesce(id_, F.lit(0)).alias(doc), F.xxhash64(F.coalesce("text", F.lit(""))).alias(t))


def classified(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """doc_id, t, n_shingles, class, class_key, component_key: a row for each row of docs. A key is struct(none, doc, t): the smallest id, null
    as the last of all, and its text."""
    spark = docs.sparkSession
    n = parts(spark, docs)
    frequent = word_levels(docs)
    own = identified(docs.select("doc_id", "text"), ["none", "doc", "t"])
    rows = saved(own.select(F.col("doc_id").cast("long").alias("doc_id"), "t", "text").mapInArrow(settled(_prefixes(n, frequent)), ROWS), "signature-prefixes")
    each = rows.where("part is null").select("doc_id", "t", "n_shingles", "class")
    blocks = rows.where("part is not null").select("part", "tokens", "classes").repartitionById(n, F.col("part"))
    maps = rows.where("bitmap is not null").groupBy("class").agg(F.first("n_shingles").alias("n"), F.first("bitmap").alias("bitmap"))
    groups = saved(blocks.mapInArrow(settled(_groups), "group long, class long").distinct().join(maps.select("class", "n"), "class").select("group", "class", "n"), "signature-groups")
    with_maps = lambda x: x.join(maps.select("class", "bitmap"), "class").select("task", "class", "name", "n", "bitmap")
    candidates = grouped_components(groups, with_maps, _ties, n, chunk, "signature-ties")
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("doc"), F.col("t").alias("t"))
    keys = saved(each.where("class is not null").groupBy("class").agg(F.min(key).alias("class_key"), F.first("n_shingles").alias("n"), F.count(F.lit(1)).alias("n_rows")), "signature-classes")
    members = candidates.join(keys, "class").select(F.col("root").alias("group"), "class", "n")

    def with_texts(x: DataFrame) -> DataFrame:
        asked = x.join(keys.select("class", "class_key.*"), "class")
        # by merge at any size: the plan is to be the same for small tables and large ones
        return own.join(asked.hint("merge"), ["none", "doc", "t"]).select("task", "class", "name", "n", "text")

    known = grouped_components(members, with_texts, _linked(frequent), n, chunk, "signature-links").join(keys.select("class", "class_key"), "class")
    low = known.groupBy("root").agg(F.min("class_key").alias("low"))
    by_class = keys.join(known.join(low, "root").select("class", "low"), "class", "left").select("class", "class_key", F.coalesce("low", "class_key").alias("component_key"), "n_rows")
    # a hot class's rows are dealt to several tasks
    total = each.count()
    salts = F.ceil(F.col("n_rows") * HOT_CLASSES / F.lit(max(1, total))).cast("int")
    hot = F.broadcast(keys.where(F.col("n_rows") * HOT_CLASSES > total).select("class", salts.alias("salts")))
    salt = F.pmod(F.xxhash64("doc_id", "t", F.monotonically_increasing_id()), F.coalesce("salts", F.lit(1))).cast("int")
    dealt = each.join(hot, "class", "left").withColumn("salt", salt).drop("salts")
    by_class = by_class.join(hot, "class", "left").select("class", "class_key", "component_key", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
    out = dealt.join(by_class, ["class", "salt"], "left")
    return out.select("doc_id", "t", "n_shingles", "class", F.coalesce("class_key", key).alias("class_key"), F.coalesce("component_key", key).alias("component_key"))


def joined(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_shingles, class_id, component_id; a row for each row of docs."""
    named = lambda c: F.when(~F.col(c)["none"], F.col(c)["doc"])
    return classified(docs.select("doc_id", "text"), chunk).select("doc_id", "n_shingles", named("class_key").alias("class_id"), named("component_key").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of docs for each component, that of the smallest id, with all columns; documents without words stay, the same row but once."""
    names = fresh(docs.columns, "__none", "__doc", "__t")
    kept = classified(docs.select("doc_id", "text")).select("component_key.*").toDF(*names).distinct()
    rows = identified(docs, names).join(kept.hint("merge"), names, "left_semi")
    return rows.dropDuplicates(names).select(*docs.columns)


def oracle() -> str:
    """The same in DuckDB's SQL, without class_id."""
    return r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT r, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
l AS (SELECT p.a, p.b FROM (SELECT x.r AS a, y.r AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.r <> y.r GROUP BY ALL) p JOIN n u ON u.r = a JOIN n v ON v.r = b WHERE 100 * k >= 80 * (u.n + v.n - k)),
c(a, b) AS (SELECT r, r FROM d UNION SELECT c.a, l.b FROM c JOIN l ON c.b = l.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, min(e.doc_id) AS component_id FROM c JOIN d ON d.r = c.a JOIN d e ON e.r = c.b LEFT JOIN n ON n.r = d.r GROUP BY d.r, d.doc_id, n
"""
