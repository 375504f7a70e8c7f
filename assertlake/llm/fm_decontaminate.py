"""Benchmark decontamination: an FM-index over each shard of the documents.

A shard's words become numbers of the benchmark's vocabulary. A word outside of it can be in no test
phrase, so it only separates; runs shorter than the shortest phrase can hold none and are left out. Over
what remains (nothing that could match is lost) the index has a suffix array, the Burrows-Wheeler transform
in a wavelet tree, and suffix positions sampled every SAMPLE symbols and at each run's start. All phrases
are searched backwards at once by wavelet-tree ranks; their occurrences are located by walking back to a
sampled position; overlapping occurrences merge into removal spans.

Nothing is shuffled: a task indexes what it reads, shard by shard; a shard ends at SHARD_SYMBOLS symbols or SHARD_BYTES of rows, a longer
text is a shard of its own. The phrases are broadcast; where the benchmark has more than PHRASE_BYTES, it is taken in parts of that size: the
driver holds one at a time, and what the search of a part has found is saved before the next.

Null, empty or word-free texts: no words, no hits. Empty benchmark: no hits. Repeated rows: each gives a row.
Repeated item ids: one item with the windows of all its rows. Null item ids: such rows are not items. Texts of any length. Empty table: no
rows. Other columns, whatever their names, are carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from assertlake.llm.common import ALNUM, LOWER, Words, buffers, fresh, ngram_hashes, ranges, removed, saved, settled, slices, written

WINDOW = 13
SAMPLE = 16
SHARD_SYMBOLS = 1 << 20
SHARD_BYTES = 32 << 20
PHRASE_BYTES = 16 << 20

#: The columns that the search adds, with more underscores where they clash; spans are in words, ends excluded.
FOUND = ["__fm_n_words", "__fm_starts", "__fm_ends", "__fm_items"]
FOUND_TYPES = [T.LongType(), T.ArrayType(T.IntegerType()), T.ArrayType(T.IntegerType()), T.ArrayType(T.StringType())]


class Phrases:
    """The distinct windows of benchmark texts: each a run of flat, vocabulary numbers (1 and up), and the items that have it."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        data, offsets = buffers(pa.array([t or "" for _, t in items], pa.string()))
        words = Words(LOWER[data], offsets, ALNUM)
        h = words.hashes()
        self.vocabulary = np.unique(h)
        self.flat = (np.searchsorted(self.vocabulary, h) + 1).astype(np.int32)
        self.names = sorted({n for n, _ in items})
        at = {n: i for i, n in enumerate(self.names)}
        owner = np.array([at[n] for n, _ in items], np.int64)
        size = np.diff(words.first)
        short = np.flatnonzero((size > 0) & (size < window))
        first = words.first[:-1]
        keys = [ngram_hashes(h[a : a + n], n) for a, n in zip(first[short].tolist(), size[short].tolist())]
        long = np.maximum(0, size - window + 1)
        start = ranges(first, long)
        key = np.concatenate([ngram_hashes(h, window)[start], *keys])
        start = np.concatenate([start, first[short]])
        length = np.concatenate([np.full(int(long.sum()), window), size[short]])
        item = np.concatenate([np.repeat(owner, long), owner[short]])
        # by length and hash; each window once with its items
        order = np.lexsort((item, key, length))
        start, length, item, key = start[order], length[order], item[order], key[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (length[1:] != length[:-1])
        self.start, self.length = start[new], length[new]
        kept = new.copy()
        kept[1:] |= item[1:] != item[:-1]
        self.item = item[kept]
        self.item_first = np.append(np.flatnonzero(new[kept]), len(self.item))

    @property
    def shortest(self) -> int:
        return int(self.length.min()) if len(self.length) else 0


class WaveletTree:
    """Level by level bit vectors; rank counts a symbol before a position in one step a level."""

    def __init__(self, text: np.ndarray, size: int):
        self.bits = max(1, int(size - 1).bit_length())
        self.levels, self.zeros = [], []
        at = text
        for level in range(self.bits - 1, -1, -1):
            bit = ((at >> level) & 1).astype(bool)
            ones = np.zeros(len(at) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.levels.append(ones)
            self.zeros.append(len(at) - int(ones[-1]))
            at = np.concatenate([at[~bit], at[bit]])
        self.size = len(text)

    def rank(self, symbol: np.ndarray, position: np.ndarray) -> np.ndarray:
        """How often symbol[i] is before position[i]."""
        low, at = np.zeros_like(position), position.copy()
        for level, (ones, zeros) in enumerate(zip(self.levels, self.zeros)):
            one = ((symbol >> (self.bits - 1 - level)) & 1).astype(bool)
            low = np.where(one, zeros + ones[low], low - ones[low])
            at = np.where(one, zeros + ones[at], at - ones[at])
        return at - low

    def access(self, position: np.ndarray) -> np.ndarray:
        """The symbols at positions."""
        at, out = position.copy(), np.zeros_like(position)
        for ones, zeros in zip(self.levels, self.zeros):
            one = ones[at + 1] > ones[at]
            at = np.where(one, zeros + ones[at], at - ones[at])
            out = out * 2 + one
        return out


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Prefix doubling. Zeros are separators, each smaller than what is later and all smaller than symbols."""
    n = len(text)
    zeros = np.cumsum(text == 0)
    rank = np.where(text == 0, zeros - 1, text + zeros[-1]).astype(np.int64)
    order = np.argsort(rank, kind="stable")
    step = 1
    while True:
        first = rank[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], first[1:] != first[:-1]])) if step == 1 else first
        later = np.zeros(n, np.int64)
        later[: max(0, n - step)] = rank[step:] + 1
        key = rank * (n + 1) + later
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.cumsum(np.concatenate([[0], sorted_key[1:] != sorted_key[:-1]]))
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        step *= 2


class FMIndex:
    """text: symbols from 1, runs ended by 0; the last is 0."""

    def __init__(self, text: np.ndarray, size: int):
        order = suffix_array(text)
        self.bwt = WaveletTree(text[order - 1], size)
        self.before = np.searchsorted(text[order], np.arange(size + 1))
        run_start = np.concatenate([[True], text[:-1] == 0])
        sampled = (run_start | (np.arange(len(text)) % SAMPLE == 0))[order]
        self.sample_rank = np.concatenate([[0], np.cumsum(sampled)])
        self.sampled, self.samples = sampled, order[sampled]

    def search(self, flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix ranges [low, high) that start with each pattern, a run of flat."""
        low, high = np.zeros(len(length), np.int64), np.full(len(length), self.bwt.size, np.int64)
        for back in range(1, int(length.max(initial=0)) + 1):
            on = np.flatnonzero((length >= back) & (low < high))
            if not len(on):
                break
            symbol = flat[start[on] + length[on] - back].astype(np.int64)
            low[on] = self.before[symbol] + self.bwt.rank(symbol, low[on])
            high[on] = self.before[symbol] + self.bwt.rank(symbol, high[on])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: steps back to a sampled row, plus the steps."""
        at, steps, out = rows.copy(), 0, np.full(len(rows), -1, np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            here = self.sampled[at]
            out[open_[here]] = self.samples[self.sample_rank[at[here]]] + steps
            open_, at = open_[~here], at[~here]
            symbol = self.bwt.access(at)
            at = self.before[symbol] + self.bwt.rank(symbol, at)
            steps += 1
        return out


class Shard:
    """Collects documents, then finds all occurrences of the phrases in them."""

    def __init__(self, phrases: Phrases):
        self.phrases = phrases
        self.clear()

    def clear(self) -> None:
        self.docs, self.n_symbols = 0, 0
        self.symbols: list[np.ndarray] = []
        self.owner: list[np.ndarray] = []
        self.word: list[np.ndarray] = []

    def add(self, words: Words) -> None:
        vocabulary, shortest = self.phrases.vocabulary, self.phrases.shortest
        n_docs = len(words.first) - 1
        if shortest and len(words.start):
            h = words.hashes()
            at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
            known = vocabulary[at] == h
            # runs of known words within a document
            begin = known.copy()
            begin[1:] &= ~known[:-1]
            cuts = words.first[1:-1]
            cuts = cuts[cuts < len(known)]
            begin[cuts] = known[cuts]
            starts = np.flatnonzero(begin)
            stop = known.copy()
            stop[:-1] &= ~known[1:]
            back = cuts[cuts > 0] - 1
            stop[back] = known[back]
            lengths = np.flatnonzero(stop) + 1 - starts
            keep = lengths >= shortest
            starts, lengths = starts[keep], lengths[keep]
            if len(starts):
                # each run with one more place, for its separator
                place = ranges(starts, lengths + 1)
                ends = np.cumsum(lengths + 1) - 1
                symbol = at[np.minimum(place, len(at) - 1)].astype(np.int64) + 1
                symbol[ends] = 0
                doc = np.searchsorted(words.first, starts, "right") - 1
                self.symbols.append(symbol)
                self.owner.append(np.repeat(doc + self.docs, lengths + 1))
                self.word.append(place - words.first[np.repeat(doc, lengths + 1)])
                self.n_symbols += len(symbol)
        self.docs += n_docs

    def occurrences(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, first word, phrase) of every occurrence."""
        none = np.zeros(0, np.int64)
        if not self.symbols:
            return none, none, none
        text, owner, word = (np.concatenate(x) for x in (self.symbols, self.owner, self.word))
        index = FMIndex(text, len(self.phrases.vocabulary) + 1)
        low, high = index.search(self.phrases.flat, self.phrases.start, self.phrases.length)
        found = index.locate(ranges(low, high - low))
        return owner[found], word[found], np.repeat(np.arange(len(low)), high - low)


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of each document that overlap or touch become one."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    wide = int(end.max()) + 2
    reach = np.maximum.accumulate(doc * wide + end)
    new = np.concatenate([[True], doc[1:] * wide + start[1:] > reach[:-1]])
    at = np.flatnonzero(new)
    return doc[at], start[at], reach[np.concatenate([at[1:] - 1, [len(doc) - 1]])] - doc[at] * wide


def _scanner(phrases: Phrases, carry: list[str], added: list[str]):
    """carry: the columns to pass on; added: what FOUND is called."""

    def flush(shard: Shard, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        n = rows.num_rows
        doc, first, phrase = shard.occurrences()
        a, b, c = doc, first, first + phrases.length[phrase]
        if added[1] in rows.column_names:  # spans and items that earlier parts of the benchmark have given
            old = [rows[x].combine_chunks() for x in added[1:3]]
            a = np.concatenate([a, np.repeat(np.arange(n), np.diff(old[0].offsets.to_numpy()))])
            b, c = (np.concatenate([x, y.flatten().to_numpy()]) for x, y in ((b, old[0]), (c, old[1])))
        a, b, c = merged(a, b, c)
        offsets = pa.array(np.searchsorted(a, np.arange(n + 1)).astype(np.int32))
        names: list[set] = [set() for _ in range(n)]
        if len(phrase):
            per = np.diff(phrases.item_first)[phrase]
            pairs = np.unique(np.repeat(doc, per) * len(phrases.names) + phrases.item[ranges(phrases.item_first[phrase], per)])
            for x in pairs:
                names[x // len(phrases.names)].add(phrases.names[x % len(phrases.names)])
        if added[3] in rows.column_names:
            for x, y in zip(names, rows[added[3]].to_pylist()):
                x.update(y)
        out = [rows[x].combine_chunks() for x in [*carry, added[0]]]
        out += [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (b, c)]
        return pa.RecordBatch.from_arrays([*out, pa.array([sorted(x) for x in names], pa.list_(pa.string()))], [*carry, *added])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, size = Shard(phrases), [], 0
        for batch in batches:
            per_row = batch.nbytes / max(1, batch.num_rows)
            for i, j, data, offsets in slices(batch.column("text")):
                words = Words(LOWER[data], offsets, ALNUM)
                shard.add(words)
                own = batch.slice(i, j - i)
                keep = [x for x in own.schema.names if x in carry or x in added[1:]]
                held.append(pa.RecordBatch.from_arrays([*(own.column(x) for x in keep), pa.array(np.diff(words.first))], [*keep, added[0]]))
                size += max(len(data), per_row * (j - i))
                if shard.n_symbols >= SHARD_SYMBOLS or size >= SHARD_BYTES:
                    yield flush(shard, held)
                    shard.clear()
                    held, size = [], 0
        if held:
            yield flush(shard, held)

    return scan


def hit_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, carry: list[str] | None = None, phrase_bytes: int = PHRASE_BYTES) -> tuple[DataFrame, list[str]]:
    """docs has a column text, benchmark (item_id, text). Returns the columns of docs that carry names (None: all) and those of FOUND; and what
    these are called."""
    names = list(docs.columns if carry is None else carry)
    added = fresh([*names, "text"], *FOUND)
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).where("item_id is not null")
    n_bytes = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_parts = max(1, -(-int(n_bytes) // phrase_bytes))
    out = docs.select(*dict.fromkeys([*names, "text"]))
    for part in range(n_parts):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(n_parts)) == part).collect()
        kept = list(dict.fromkeys([*names, "text"])) if part < n_parts - 1 else names
        schema = T.StructType([*(docs.schema[x] for x in kept), *(T.StructField(c, t) for c, t in zip(added, FOUND_TYPES))])
        begin = written()
        out = out.mapInArrow(settled(_scanner(Phrases([tuple(x) for x in rows], window), kept, added)), schema)
        if part < n_parts - 1:
            out = saved(out, "fm-part")
            removed(docs.sparkSession, begin - (part > 0), keep=1)
    return out, added


def hit_words(added: list[str]) -> Column:
    """How many words the spans hold."""
    return F.aggregate(F.zip_with(added[2], added[1], lambda e, s: e - s), F.lit(0), lambda a, x: a + x).cast("long")


def digested(found: DataFrame, added: list[str]) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of what the search has found."""
    n_words, hit, items = F.col(added[0]), hit_words(added), added[3]
    rows = found.select("doc_id", n_words.alias("n_words"), hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"))
    return rows.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def judged(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """digested() of docs; a row for each row of docs."""
    return digested(*hit_spans(docs.select("doc_id", "text"), benchmark, carry=["doc_id"]))


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that are not contaminated. Those with hits under one word in twenty stay whole: items of a few
    words occur in clean prose, and cutting them would damage it."""
    found, added = hit_spans(docs, benchmark)
    hit = hit_words(added)
    return found.where((hit == 0) | (20 * hit < F.col(added[0]))).select(*docs.columns)


def oracle(window: int = WINDOW) -> str:
    """The same in DuckDB's SQL: windows of words joined by their text."""
    words = lambda x: rf"regexp_extract_all(translate(coalesce({x}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, {words("text")} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, {words("text")} AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item, least({window}, len(w)) AS n, array_to_string(w[i : i + least({window}, len(w)) - 1], ' ') AS g FROM (SELECT item, w, unnest(range(1, greatest(2, len(w) - {window} + 2))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT row_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT row_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
h AS (SELECT row_id, i, n, item FROM dw JOIN bw USING (n, g)),
p AS (SELECT row_id, count(DISTINCT p) AS n_hit FROM (SELECT row_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY row_id),
k AS (SELECT row_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY row_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN p USING (row_id) LEFT JOIN k USING (row_id)
"""
