"""LM scoring: a Katz backoff trigram model with Good-Turing discounts and exactly normalised backoff weights.

p(w | u v) is d(c) * c(u v w) / c(u v) for a trigram of the training texts, else alpha(u v) * p(w | v); p(w | v) is d(c) * c(v w) / c(v) for a bigram,
else alpha(v) * p(w); p(w) is d(c) * c(w) / N, and an unknown word, one type as in the base model, has the mass that the discounts leave.
alpha(h) makes the probabilities after h sum to 1; an unknown h backs off with weight 1.
Counts of up to TURING occurrences are discounted by Good-Turing, with Katz's correction, or up to as many as give discounts in (0, 1]; where the
counts of counts allow none, half an occurrence is taken off. Trigrams that occur once count as unseen (the usual cut-off), the others are
discounted by Good-Turing as it is. A context without any discounted count gives up 1 / (c(h) + 1).

How it is spread out: a task makes batches of about BATCH_TOKENS tokens with a vocabulary of their own. Vocabularies go in blocks to tasks by
range of the word's hash, which sum counts and answer each batch with its words' numbers and counts; the batches are written again with these. Then bigrams, unique in a batch, go in
blocks to tasks by their context, which sum counts, gather what alpha needs, and answer again. Then trigrams, in the same way: only
those of bigrams that occur twice, since others can't, and in PASSES runs. Each batch then evaluates its tokens by recursion.
Only the counts of counts (a few numbers) and the counts of the TOP most frequent words pass the driver. The answers beside it, the tasks store the model: tables of uni-, bi- and trigrams
with counts, partitioned in the same way. scored_by() scores texts by stored tables: they go beside the texts' blocks to the same tasks.

A text's first token follows the end token, which also is its last; its first has no trigram context. Words are known by 64-bit hashes.

Null or empty text: one token, the end. Null doc_id: its text counts as empty for crc32, remainder 0, so it trains. Repeated rows: each counts and
gives a row. No training rows: N and V are 0, and both scores give each token the mass of the unknown. Empty table: no rows. Texts of
any length. Other columns are not read.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from assertlake.llm.common import LOWER, SPACED, Words, deleted, mix, parts, settled, shared_dir, shuffles_removed, slices

BATCH_TOKENS = 1_000_000
#: Buckets of batches for each part: the batches of a bucket, with their answers, are in memory together.
BUCKETS = 2
TURING = 5
#: The counts of so many of the most frequent words go to all tasks, so that blocks of bigrams bring only those of the others.
TOP = 1 << 17
#: Trigrams are asked for in so many runs, for a share of the parts each: only that share of the blocks is on disk at once.
PASSES = 2
END = np.uint64(0x656E64)


def planes(a: np.ndarray) -> bytes:
    """Non-negative whole numbers: byte planes without those that are zero, compressed."""
    raw = np.ascontiguousarray(a, "<i8").view(np.uint8).reshape(-1, 8)
    width = int(np.max(np.flatnonzero(raw.any(0)), initial=0)) + 1
    return len(a).to_bytes(8, "little") + bytes([width]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(raw[:, :width].T).tobytes())


def numbers(blob: bytes) -> np.ndarray:
    n, width = int.from_bytes(blob[:8], "little"), blob[8]
    out = np.zeros(n, "<i8")
    if n:
        out.view(np.uint8).reshape(n, 8)[:, :width] = np.frombuffer(zstandard.ZstdDecompressor().decompress(memoryview(blob)[9:]), np.uint8).reshape(width, n).T
    return out


def packed(*columns: np.ndarray) -> np.ndarray | None:
    """One number for each row, in the rows' order; None where 63 bits don't hold it."""
    sizes = [int(c.max(initial=0)) + 1 for c in columns]
    if math.prod(sizes) >= 1 << 63:
        return None
    out = columns[0]
    for c, n in zip(columns[1:], sizes[1:]):
        out = out * n + c
    return out


def row_order(*columns: np.ndarray) -> np.ndarray:
    key = packed(*columns)
    return np.lexsort(columns[::-1]) if key is None else np.argsort(key)


def unique_rows(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each different row of non-negative numbers is, in sorted order, and the number of each row there."""
    order = row_order(*columns)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        own = c[order]
        new[1:] |= own[1:] != own[:-1]
    at = np.empty(len(order), np.int64)
    at[order] = np.cumsum(new) - 1
    return order[new], at


def steps(a: np.ndarray) -> bytes:
    """Whole numbers that don't fall."""
    return planes(np.diff(a, prepend=0))


def from_steps(blob: bytes) -> np.ndarray:
    return np.cumsum(numbers(blob))


def runs(a: np.ndarray, size: np.ndarray) -> bytes:
    """Whole numbers that rise within runs of these sizes."""
    first = np.cumsum(size[size > 0]) - size[size > 0]
    out = np.diff(a, prepend=0)
    out[first] = a[first]
    return planes(out)


def from_runs(blob: bytes, size: np.ndarray) -> np.ndarray:
    out = np.cumsum(numbers(blob))
    some = size[size > 0]
    first = np.cumsum(some) - some
    before = np.concatenate([[0], out])[first]
    return out - np.repeat(before, some)


def by_word(w: np.ndarray, own: np.ndarray) -> bytes:
    """A number that each word has, once for each different word, as differences in the order of the words' numbers: near ones are alike."""
    rise = np.diff(own[np.unique(w, return_index=True)[1]], prepend=0)
    return planes(np.where(rise < 0, -2 * rise - 1, 2 * rise))


def from_by_word(blob: bytes, w: np.ndarray) -> np.ndarray:
    rise = numbers(blob)
    return np.cumsum(np.where(rise & 1, -(rise + 1 >> 1), rise >> 1))[np.unique(w, return_inverse=True)[1]]


def falling(number: np.ndarray, count: np.ndarray) -> bytes:
    """Counts that fall as the words' numbers rise."""
    return steps(count[np.argsort(-number)])


def from_falling(blob: bytes, number: np.ndarray) -> np.ndarray:
    out = np.empty(len(number), np.int64)
    out[np.argsort(-number)] = from_steps(blob)
    return out


BATCHES = "batch long, ids array<long>, train binary, sizes binary, tokens binary, words binary, counts binary"
#: The same with the answers to the words in their place: words in the order of their numbers, tokens as places there.
NUMBERED = "batch long, ids array<long>, train binary, sizes binary, tokens binary, number binary, count binary"


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, train, text) -> batches; tokens are places in the batch's words in the order of their frequency, so that most are small."""
    names = [x.split()[0] for x in BATCHES.split(", ")]
    number = TaskContext.get().partitionId() << 24
    ids, train, sizes, hashes, n = [], [], [], [], 0

    def flush() -> pa.RecordBatch:
        nonlocal number
        size, trains = np.concatenate(sizes), np.concatenate(train)
        words, tokens = np.unique(np.concatenate(hashes), return_inverse=True)
        order = np.argsort(-np.bincount(tokens, minlength=len(words)), kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        words, tokens = words[order], place[tokens]
        counts = np.bincount(tokens[np.repeat(trains, size)], minlength=len(words))
        all_ids = pa.concat_arrays(ids)
        out = [pa.array([number]), pa.ListArray.from_arrays(pa.array([0, len(all_ids)], pa.int32()), all_ids), *(pa.array([x], pa.binary()) for x in (planes(trains), planes(size), planes(tokens), words.tobytes(), planes(counts)))]
        number += 1
        return pa.RecordBatch.from_arrays(out, names)

    for batch in batches:
        for i, j, data, offsets in slices(batch.column("text")):
            words = Words(LOWER[data], offsets, SPACED)
            ids.append(batch.column("doc_id").slice(i, j - i))
            train.append(batch.column("train").slice(i, j - i).to_numpy(zero_copy_only=False).astype(bool))
            sizes.append(np.diff(words.first) + 1)
            hashes.append(np.insert(words.hashes(), words.first[1:], END))
            n += len(hashes[-1])
            if n >= BATCH_TOKENS:
                yield flush()
                ids, train, sizes, hashes, n = [], [], [], [], 0
    if n:
        yield flush()


#: batch is null for a stored part of a model.
BLOCKS = "part int, batch long, a binary, b binary, c binary, d binary, e binary, f binary"
BLOCK_NAMES = [x.split()[0] for x in BLOCKS.split(", ")]
#: kind: answer (to a batch), model (a part of the table of n-grams, as a block), stats (counts of counts, numbers of tokens and types), top (counts of
#: a part's most frequent words).
ANSWERS = "kind string, part int, batch long, a binary, b binary, c binary, d binary, e binary, f binary, stats array<long>"


def block(part: int, batch: int, *blobs: bytes) -> tuple:
    return (part, batch, *blobs, *[None] * (6 - len(blobs)))


def answer(kind: str, part: int, batch: int | None, *blobs: bytes, stats: list[int] | None = None) -> tuple:
    return (kind, *block(part, batch, *blobs), stats)


def rows(records: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in records], kinds[t]) for i, (_, t) in enumerate(fields)], [n for n, _ in fields])


def word_part(words: np.ndarray, n_parts: int) -> np.ndarray:
    """Ranges of hashes, so that a part is a slice of sorted words."""
    return ((words >> np.uint64(32)) * np.uint64(n_parts) >> np.uint64(32)).astype(np.int64)


def _word_blocks(n_parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, raw, counts in zip(*(batch.column(c).to_pylist() for c in ("batch", "words", "counts"))):
                words, counts = np.frombuffer(raw, np.uint64), numbers(counts)
                order = np.argsort(words)
                words, counts = words[order], counts[order]
                cut = np.searchsorted(word_part(words, n_parts), np.arange(n_parts + 1))
                yield rows([block(p, number, words[a:b].tobytes(), planes(counts[a:b])) for p, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if a < b], BLOCKS)

    return run


def by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """The blocks of each part; rows come sorted by part."""
    at, held = None, []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in BLOCK_NAMES)):
            if row[0] != at and held:
                yield at, held
                held = []
            at = row[0]
            held.append(row[1:])
    if held:
        yield at, held


def counts_of_counts(c: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(c, TURING + 2), minlength=TURING + 3)[1 : TURING + 2].tolist()


def top_ranks(n_parts: int) -> int:
    """How many words of each part are among the most frequent; their numbers are those under n_parts times that."""
    return -(-TOP // n_parts)


def _unigrams(n_parts: int):
    """Sums the counts of a part's words; answers with counts and numbers: frequent words get small ones, words of one count in the order of their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, blocks in by_part(batches):
            own = [np.frombuffer(b[1], np.uint64) for b in blocks]
            words, at = np.unique(np.concatenate(own), return_inverse=True)
            total = np.bincount(at, np.concatenate([numbers(b[2]) for b in blocks]), len(words)).astype(np.int64)
            rank, order = np.empty(len(words), np.int64), np.argsort(-total, kind="stable")
            rank[order] = np.arange(len(words))
            seen, top = total > 0, total[order[: top_ranks(n_parts)]]
            out = [answer("stats", part, None, stats=[int(total.sum()), int(seen.sum()), *counts_of_counts(total)]), answer("model", part, None, words[seen].tobytes(), planes(total[seen])), answer("top", part, None, falling(np.arange(len(top)), top))]
            begin = 0
            for b, w in zip(blocks, own):
                mine = at[begin : begin + len(w)]
                begin += len(w)
                if b[0] is not None:
                    out.append(answer("answer", part, b[0], steps(rank[mine][np.argsort(-total[mine], kind="stable")]), planes(total[mine])))
            yield rows(out, ANSWERS)

    return run


def _numbered(n_parts: int):
    """Puts the answers to a batch's words, which are in the order of hashes, in their place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in batches:
            for row in records(some):
                answered = np.argsort(np.frombuffer(row["words"], np.uint64))
                number, count = np.empty((2, len(answered)), np.int64)
                begin = 0
                for x in sorted(row["words_answers"], key=lambda x: x["part"]):
                    own = numbers(x["b"])
                    mine = answered[begin : begin + len(own)]
                    begin += len(own)
                    count[mine], number[mine[np.argsort(-own, kind="stable")]] = own, from_steps(x["a"]) * n_parts + x["part"]
                order = np.argsort(number)
                place = np.empty_like(order)
                place[order] = np.arange(len(order))
                number, count = number[order], count[order]
                yield rows([(row["batch"], row["ids"], row["train"], row["sizes"], planes(place[numbers(row["tokens"])]), steps(number), by_word(number, count))], NUMBERED)

    return run


@dataclass
class Batch:
    """A batch with the numbers (rising) and counts of its words; prev is the place of each token's context."""

    ids: list
    train: np.ndarray
    sizes: np.ndarray
    tokens: np.ndarray
    number: np.ndarray
    count: np.ndarray
    prev: np.ndarray

    @classmethod
    def of(cls, row: dict) -> Batch:
        number = from_steps(row["number"])
        count = from_by_word(row["count"], number)
        sizes, tokens = numbers(row["sizes"]), numbers(row["tokens"]).astype(np.int32)
        ends = np.cumsum(sizes) - 1
        prev = np.empty_like(tokens)
        prev[1:] = tokens[:-1]
        prev[0] = tokens[ends[0]]  # the end token, as at each text's begin
        return cls(row["ids"], numbers(row["train"]).astype(bool), sizes, tokens, number, count, prev)

    def pairs(self, n_parts: int):
        """The unique bigrams of known contexts: (place of h, place of w, part), sorted by part and numbers; and each token's bigram, -1 for none."""
        part = (mix(self.number.astype(np.uint64)) % np.uint64(n_parts)).astype(np.int64)
        known = np.flatnonzero(self.count[self.prev] > 0)
        # words by (part as a context, number), so that places of the pair tell its order
        by = np.argsort(part, kind="stable")
        head = np.empty(len(by), np.int64)
        head[by] = np.arange(len(by))
        unique, at = np.unique(head[self.prev[known]] * len(by) + self.tokens[known], return_inverse=True)
        h, w = by[unique // max(1, len(by))], unique % max(1, len(by))
        of = np.full(len(self.tokens), -1, np.int32)
        of[known] = at
        return h, w, part[h], of


def groups(sorted_values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]])) if len(sorted_values) else np.zeros(0, np.int64)


def records(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
        yield row
        row.clear()  # its numbers are as large as what is made of them


def rare_counts(w: np.ndarray, own: np.ndarray, n_top: int) -> bytes:
    """The words' own counts but for the words with numbers under n_top."""
    return by_word(w[w >= n_top], own[w >= n_top])


def from_rare_counts(blob: bytes, w: np.ndarray, top: np.ndarray) -> np.ndarray:
    out = top[np.minimum(w, len(top) - 1)]
    out[w >= len(top)] = from_by_word(blob, w[w >= len(top)])
    return out


def _bigram_blocks(n_parts: int):
    """Blocks: numbers of contexts, how many words follow each, the words' numbers, counts in training, and the words' own counts, once for each word that
    is not among the most frequent."""
    n_top = n_parts * top_ranks(n_parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in batches:
            for row in records(some):
                b = Batch.of(row)
                h, w, part, of = b.pairs(n_parts)
                trained = of[np.repeat(b.train, b.sizes)]
                counts = np.bincount(trained[trained >= 0], minlength=len(h))
                cut = np.searchsorted(part, np.arange(n_parts + 1))
                out = []
                for p, (i, j) in enumerate(zip(cut[:-1], cut[1:])):
                    if i < j:
                        first = groups(h[i:j])
                        size = np.diff(np.append(first, j - i))
                        out.append(block(p, row["batch"], steps(b.number[h[i:j][first]]), planes(size), runs(b.number[w[i:j]], size), planes(counts[i:j]), rare_counts(b.number[w[i:j]], b.count[w[i:j]], n_top)))
                yield rows(out, BLOCKS)

    return run


def _bigrams(top: np.ndarray):
    """Sums the counts of a part's bigrams; answers with them, and for each context: which counts 1 to TURING its bigrams have (a bit each). Only where a
    batch has an unseen bigram after it, which alone needs alpha, also: its bigrams by count 1 to TURING, the sum of the own counts (over TURING) of the
    words seen after it, and those words by own count 1 to TURING. top: the own counts of the most frequent words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, blocks in by_part(batches):
            contexts, follow = [from_steps(b[1]) for b in blocks], [numbers(b[2]) for b in blocks]
            h = np.concatenate([np.repeat(c, n) for c, n in zip(contexts, follow)])
            followers = [from_runs(b[3], n) for b, n in zip(blocks, follow)]
            own = np.concatenate([from_rare_counts(b[5], x, top) for b, x in zip(blocks, followers)])
            w, counts = np.concatenate(followers), np.concatenate([numbers(b[4]) for b in blocks])
            del followers
            sizes = [int(n.sum()) for n in follow]
            where, at = unique_rows(h, w)
            total = np.bincount(at, counts, len(where)).astype(np.int64)
            pair_h, pair_own = h[where], own[where]
            names, context = np.unique(pair_h, return_inverse=True)
            seen = total > 0
            stats = np.zeros((len(names), 2 * TURING + 1), np.int64)
            for r in range(1, TURING + 1):
                stats[:, r - 1] = np.bincount(context[total == r], minlength=len(names))
                stats[:, TURING + r] = np.bincount(context[seen & (pair_own == r)], minlength=len(names))
            high = seen & (pair_own > TURING)
            stats[:, TURING] = np.bincount(context[high], pair_own[high], len(names)).astype(np.int64)
            first = groups(pair_h[seen])
            size = np.diff(np.append(first, seen.sum()))
            table = steps(pair_h[seen][first]), planes(size), runs(w[where][seen], size), planes(total[seen]), rare_counts(w[where][seen], pair_own[seen], len(top))
            out = [answer("stats", part, None, stats=[int(total.sum()), int(seen.sum()), *counts_of_counts(total)]), answer("model", part, None, *table)]
            begin = 0
            some = (stats[:, :TURING] > 0) @ (1 << np.arange(TURING))
            for b, c, n, size in zip(blocks, contexts, sizes, follow):
                if b[0] is not None:
                    mine, here = total[at[begin : begin + n]], np.searchsorted(names, c)
                    asked = np.bincount(np.repeat(np.arange(len(c)), size)[mine == 0], minlength=len(c)) > 0
                    out.append(answer("answer", part, b[0], planes(mine), planes(some[here]), planes(stats[here[asked]].T.ravel())))
                begin += n
            yield rows(out, ANSWERS)

    return run


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums the counts of a part's trigrams; answers with them, and for each context whether trigrams that count follow it beside the batch's own. Only
    then, since the batch can tell the rest: its trigrams by count 2 to TURING and the sum of counts over TURING, and in the same way, for contexts with
    a token that backs off, the counts of the bigrams of the context's last word and the words of its trigrams."""
    for part, blocks in by_part(batches):
        yield rows(list(_trigram_part(part, blocks)), ANSWERS)


def by_count(count: np.ndarray, context: np.ndarray, n: int) -> np.ndarray:
    """How many counts each context has of 2 to TURING, and the sum of the greater ones."""
    out = np.zeros((n, TURING), np.int64)
    for r in range(2, TURING + 1):
        out[:, r - 2] = np.bincount(context[count == r], minlength=n)
    high = count > TURING
    out[:, TURING - 1] = np.bincount(context[high], count[high], n).astype(np.int64)
    return out


def _trigram_part(part: int, blocks: list[tuple]) -> Iterator[tuple]:
    own = []
    for _, a, b, c, d, *rest in blocks:
        alone, size = numbers(c) & 1, numbers(c) >> 1
        own.append((from_steps(a), numbers(b), size, from_runs(d, size), *(numbers(x) for x in rest), alone))
    context_u, context_v, size = (np.concatenate([x[k] for x in own]) for k in (0, 1, 2))
    w, counts, pairs = (np.concatenate([x[k] for x in own]) for k in (3, 4, 5))
    names, asked = unique_rows(context_u, context_v)
    context = np.repeat(asked, size)
    where, at = unique_rows(context, w)
    total = np.bincount(at, counts, len(where)).astype(np.int64)
    context = context[where]
    kept = total > 1
    n_kept = np.bincount(context[kept], minlength=len(names))
    stats, mass = by_count(total[kept], context[kept], len(names)), by_count(pairs[where][kept], context[kept], len(names))
    at_kept, first = where[kept], groups(context[kept])
    named = names[context[kept][first]]
    size = np.diff(np.append(first, len(at_kept)))
    yield answer("stats", part, None, stats=[int(total.sum()), int(kept.sum()), *counts_of_counts(total)])
    yield answer("model", part, None, steps(context_u[named]), planes(context_v[named]), planes(2 * size), runs(w[at_kept], size), planes(total[kept]), planes(pairs[at_kept]))
    begin, first_context = 0, 0
    for b, x in zip(blocks, own):
        mine = asked[first_context : first_context + len(x[0])]
        if b[0] is not None:
            found = total[at[begin : begin + len(x[3])]]
            own_kept = np.bincount(np.repeat(np.arange(len(mine)), x[2])[found > 1], minlength=len(mine))
            more, backs_off = n_kept[mine] > own_kept, (x[6] > 0) | (own_kept < x[2])
            yield answer("answer", part, b[0], planes(found), planes(stats[mine[more]].T.ravel()), planes(mass[mine[more & backs_off]].T.ravel()), planes(np.packbits(more)))
        begin, first_context = begin + len(x[3]), first_context + len(x[0])


def discounts(n: list[int]) -> np.ndarray:
    """d[r] for r from 0 to TURING; n[r - 1] is how many n-grams occur r times, up to TURING + 1."""
    for k in range(TURING if len(n) > TURING else 0, 1, -1):
        if all(n[: k + 1]) and (common := (k + 1) * n[k] / n[0]) < 1:
            d = np.ones(TURING + 1)
            d[1 : k + 1] = [((r + 1) * n[r] / (r * n[r - 1]) - common) / (1 - common) for r in range(1, k + 1)]
            if ((d > 0) & (d <= 1)).all():
                return d
    return np.array([1.0] + [(r - 0.5) / r for r in range(1, TURING + 1)])


def cut_discounts(n: list[int]) -> np.ndarray:
    """d[r] of trigrams, 0 for one occurrence: Good-Turing from two occurrences up, as far as it gives discounts in (0, 1]."""
    d = np.ones(TURING + 1)
    d[1] = 0.0
    own = [(r + 1) * n[r] / (r * n[r - 1]) if len(n) > r and n[r - 1] else 0.0 for r in range(2, TURING + 1)]
    good = next((k for k, x in enumerate(own) if not 0 < x <= 1), len(own))
    d[2 : 2 + good] = own[:good]
    if not good:
        d[2:] = [(r - 0.5) / r for r in range(2, TURING + 1)]
    return d


@dataclass
class Model:
    """What all batches need to know: number of training tokens and types, discounts by order."""

    tokens: int
    types: int
    one: np.ndarray
    two: np.ndarray
    unknown: float  # the mass of unknown words
    scale: float

    @classmethod
    def of(cls, unigrams: list[int], bigrams: list[int]) -> Model:
        tokens, types, n = (unigrams[0], unigrams[1], unigrams[2:]) if unigrams else (0, 0, [])
        one, two = discounts(n), discounts(bigrams[2:])
        left = sum((1 - one[r]) * r * n[r - 1] for r in range(1, TURING + 1)) if n else 0.0
        # without any discounted count one occurrence more stands for the unknown
        unknown, scale = (left / tokens, 1.0) if left > 0 else (1 / (tokens + 1), tokens / (tokens + 1))
        return cls(tokens, types, one, two, unknown, scale)

    def unigram(self, c: np.ndarray) -> np.ndarray:
        seen = self.scale * self.one[np.where(c <= TURING, c, 0)] * c / max(1, self.tokens)
        return np.where(c > 0, seen, self.unknown)

    def context(self, c: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(factor of seen bigrams' discounted shares, alpha) of contexts with counts c and the stats of _bigrams."""
        r = np.arange(1, TURING + 1)
        left = stats[:, :TURING] @ ((1 - self.two[1:]) * r)
        factor, left = np.where(left > 0, 1.0, c / (c + 1.0)), np.where(left > 0, left / c, 1 / (c + 1.0))
        seen = self.scale * (stats[:, TURING] + stats[:, TURING + 1 :] @ (self.one[1:] * r)) / max(1, self.tokens)
        return factor, left / (1 - seen)

    def discounted(self, some: np.ndarray) -> np.ndarray:
        """Whether the discounts of a context's bigrams leave anything, by the bits of the counts that they have."""
        return some & int(((self.two[1:] < 1) << np.arange(TURING)).sum()) > 0

    def pair(self, total: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """p(w | v) of bigrams that occur; weight: the context's count, doubled, plus 1 if its discounts leave nothing."""
        return self.two[np.where(total <= TURING, total, 0)] * total * self.share(weight)

    @staticmethod
    def share(weight: np.ndarray) -> np.ndarray:
        """What one discounted occurrence after a context has of it."""
        return 1 / np.maximum(1.0, (weight >> 1) + (weight & 1))

    def trigram_context(self, three: np.ndarray, c: np.ndarray, weight: np.ndarray, stats: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(factor of trigrams' discounted shares, alpha) of contexts with counts c, weights of their last words, and the answers of _trigrams."""
        r = np.arange(2, TURING + 1)
        left = c - stats[:, TURING - 1] - stats[:, : TURING - 1] @ (three[2:] * r)
        mass = (pairs[:, TURING - 1] + pairs[:, : TURING - 1] @ (self.two[2:] * r)) * self.share(weight)
        some = left > 1e-9
        factor, left = np.where(some, 1.0, c / (c + 1.0)), np.where(some, left / c, 1 / (c + 1.0))
        return factor, np.where(mass > 0, left / (1 - mass), 1.0)


class Bigrams:
    """A batch's unique bigrams with the answers to them: context h, word w, place of each token's bigram, total counts, probabilities."""

    def __init__(self, b: Batch, row: dict, model: Model, n_parts: int):
        self.h, self.w, part, self.of = b.pairs(n_parts)
        answers = sorted(row["pairs_answers"] or [], key=lambda x: x["part"])
        self.total = np.concatenate([np.zeros(0, np.int64), *(numbers(x["a"]) for x in answers)])
        first = groups(part * len(b.number) + self.h)
        context = np.repeat(np.arange(len(first), dtype=np.int32), np.diff(np.append(first, len(self.h))))
        asked = np.zeros(len(first), bool)
        asked[context[self.total == 0]] = True
        full, alpha = np.ones(len(first), bool), np.ones(len(first))  # alpha is that of the asked ones; no other is used
        begin = 0
        for x in answers:
            some = numbers(x["b"])
            at = slice(begin, begin := begin + len(some))
            full[at] = model.discounted(some)
            own = np.flatnonzero(asked[at]) + at.start
            alpha[own] = model.context(b.count[self.h[first[own]]], numbers(x["c"]).reshape(2 * TURING + 1, -1).T)[1]
        self.single = model.unigram(b.count)
        self.weight = 2 * b.count + 0  # of each word of the batch, as a context
        self.weight[self.h[first][~full]] += 1
        self.p = np.where(self.total > 0, model.pair(self.total, self.weight[self.h]), alpha[context] * self.single[self.w])

    def triples(self, b: Batch, n_parts: int):
        """The unique contexts (as places of bigrams that occur twice) and trigrams (as places of a context and a bigram), sorted by part and
        numbers; and for each token its context and its trigram, -1 for none."""
        first = np.zeros(len(b.tokens), bool)
        first[np.concatenate([[0], np.cumsum(b.sizes)[:-1]])] = True
        before = np.concatenate([self.of[:0] if not len(self.of) else self.of[-1:], self.of[:-1]])  # the first is no text's second token
        total = np.append(self.total, 0)
        on = np.flatnonzero(~first & (total[before] > 1))
        mark = np.zeros(len(total), bool)
        mark[before[on]] = True
        own = np.flatnonzero(mark)
        u, v = b.number[self.h[own]], b.number[self.w[own]]
        part = (mix(mix(u.astype(np.uint64)) * np.uint64(3) + v.astype(np.uint64)) % np.uint64(n_parts)).astype(np.int64)
        order = row_order(part, u, v)
        place = np.empty(len(total), np.int64)
        place[own[order]] = np.arange(len(order))
        context_of = np.full(len(b.tokens), -1, np.int32)
        context_of[on] = place[before[on]]
        some = on[total[self.of[on]] > 1]
        # bigrams of one context are in the order of their words' numbers
        key, at = np.unique(context_of[some].astype(np.int64) * len(total) + self.of[some], return_inverse=True)
        trigram_of = np.full(len(b.tokens), -1, np.int32)
        trigram_of[some] = at
        return own[order], part[order], key // len(total), key % len(total), context_of, trigram_of


def _trigram_blocks(model: Model, n_parts: int, turn: int):
    """Blocks: numbers of the contexts' words, how many words follow each (doubled, plus 1 if others follow it that no trigram is asked for), their numbers, counts in training, counts of the bigrams of the context's
    last word and them. Only the parts of one turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in batches:
            for row in records(some):
                b = Batch.of(row)
                two = Bigrams(b, row, model, n_parts)
                own, part, context, pair, context_of, of = two.triples(b, n_parts)
                alone = np.zeros(len(own), bool)  # contexts with a token that has no trigram to ask for
                alone[context_of[(context_of >= 0) & (of < 0)]] = True
                trained = of[np.repeat(b.train, b.sizes)]
                counts = np.bincount(trained[trained >= 0], minlength=len(pair))
                size = np.bincount(context, minlength=len(own))
                cut, begin = np.searchsorted(part, np.arange(n_parts + 1)), np.concatenate([[0], np.cumsum(size)])
                out = []
                for p, (i, j) in enumerate(zip(cut[:-1], cut[1:])):
                    if i < j and p % PASSES == turn:
                        at = slice(begin[i], begin[j])
                        out.append(block(p, row["batch"], steps(b.number[two.h[own[i:j]]]), planes(b.number[two.w[own[i:j]]]), planes(2 * size[i:j] + alone[i:j]), runs(b.number[two.w[pair[at]]], size[i:j]), planes(counts[at]), planes(two.total[pair[at]])))
                yield rows(out, BLOCKS)

    return run


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scores(model: Model, three: np.ndarray, n_parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in batches:
            for row in records(some):
                b = Batch.of(row)
                two = Bigrams(b, row, model, n_parts)
                p = np.where(two.of >= 0, np.append(two.p, 0.0)[two.of], two.single[b.tokens])
                own, part, context, pair, context_of, of = two.triples(b, n_parts)
                if len(own):
                    answers = sorted(row["triples_answers"], key=lambda x: x["part"])
                    total = np.concatenate([numbers(x["a"]) for x in answers])
                    factor, alpha = np.empty((2, len(own)))
                    on = np.flatnonzero(context_of >= 0)
                    at, count = context_of[on], np.append(total, 0)[of[on]]  # of each token with a context its trigram's count
                    backs_off = np.zeros(len(own), bool)
                    backs_off[at[count < 2]] = True
                    begin = np.append(groups(part), len(own))
                    for x, i, j in zip(answers, begin[:-1], begin[1:]):  # one part at a time
                        part, mine = slice(i, j), slice(*np.searchsorted(context, [i, j]))
                        kept = total[mine] > 1
                        after = context[mine][kept] - i
                        stats, pairs = by_count(total[mine][kept], after, j - i), by_count(two.total[pair[mine][kept]], after, j - i)
                        more = np.unpackbits(numbers(x["d"]).astype(np.uint8), count=j - i).astype(bool)
                        stats[more] = numbers(x["b"]).reshape(TURING, -1).T
                        pairs[more & backs_off[part]] = numbers(x["c"]).reshape(TURING, -1).T
                        factor[part], alpha[part] = model.trigram_context(three, two.total[own[part]], two.weight[two.w[own[part]]], stats, pairs)
                    share = factor[at] * three[np.where(count <= TURING, count, 0)] * count / two.total[own][at]
                    p[on] = np.where(count > 1, share, alpha[at] * p[on])
                del two
                p = np.log10(p)
                base = np.log10((b.count + 0.5) / (model.tokens + 0.5 * (model.types + 1)))[b.tokens]
                first = np.concatenate([[0], np.cumsum(b.sizes)[:-1]])
                columns = [pa.array(row["ids"], pa.int64()), pa.array(~b.train), pa.array(b.sizes), pa.array(np.add.reduceat((b.count > 0)[b.tokens].astype(np.int64), first)), pa.array(np.full(len(first), model.tokens)), pa.array(np.add.reduceat(base, first)), pa.array(np.add.reduceat(p, first))]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SCORES.split(", ")])

    return run


def totals(answers: DataFrame) -> list[int]:
    row = answers.where("kind = 'stats'").select(*(F.sum(F.col("stats")[i]).alias(f"n{i}") for i in range(TURING + 3))).first()
    return [int(x or 0) for x in row]


def remainder() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5


def top_counts(answers: DataFrame, n_parts: int) -> np.ndarray:
    """The counts of the most frequent words, by their numbers."""
    out = np.zeros((top_ranks(n_parts), n_parts), np.int64)
    for part, blob in answers.where("kind = 'top'").select("part", "a").collect():
        own = from_steps(blob)[::-1]
        out[: len(own), part] = own
    return out.ravel()


def scored(docs: DataFrame, held_out_remainder: int = 1, model_path: str | None = None) -> DataFrame:
    """Columns SCORES; a row for each row of docs. model_path: where the model's tables go and stay with the answers, else the shared folder, where
    answers go once they are used."""
    train = remainder() != held_out_remainder
    return _run(docs, train, model_path or shared_dir(docs.sparkSession, "katz"), None, model_path is not None)


def scored_by(docs: DataFrame, model_path: str) -> DataFrame:
    """The same by a model that scored() has stored; no row of docs trains."""
    return _run(docs, F.lit(False), shared_dir(docs.sparkSession, "katz"), model_path, False)


def _run(docs: DataFrame, train: Column, path: str, stored: str | None, keep: bool) -> DataFrame:
    spark = docs.sparkSession
    n = spark.read.schema("parts int").parquet(f"{stored}/parts").first()[0] if stored else parts(spark, docs)
    if not stored:
        spark.range(1).select(F.lit(n).alias("parts")).coalesce(1).write.parquet(f"{path}/parts")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), train.alias("train"), "text")
    buckets = BUCKETS * n

    def bucketed(df: DataFrame, table: str) -> DataFrame:
        """A bucketed table: batches stay where they are when answers are joined to them; its files stay when its name goes."""
        name = f"katz_{table}_{uuid.uuid4().hex}"
        with shuffles_removed(spark):
            df.write.bucketBy(buckets, "batch").sortBy("batch").option("path", f"{path}/{table}").saveAsTable(name)
        out = spark.table(name)
        out.schema  # resolved before the name goes
        spark.sql(f"DROP TABLE {name}")
        return out

    def asked(blocks: DataFrame, reply, table: str, turn: int | None = None) -> DataFrame:
        if stored:
            model = spark.read.schema(ANSWERS).parquet(f"{stored}/{table}").where("kind = 'model'")
            blocks = blocks.unionByName((model if turn is None else model.where(F.col("part") % PASSES == turn)).select(*BLOCK_NAMES))
        out = blocks.repartitionById(n, F.col("part")).sortWithinPartitions("part").mapInArrow(settled(reply), ANSWERS)
        with shuffles_removed(spark):
            out.write.mode("append").partitionBy("kind").parquet(f"{path}/{table}")
        return spark.read.schema(ANSWERS).parquet(f"{path}/{table}")

    def by_batch(answers: DataFrame, column: str) -> DataFrame:
        return answers.where("kind = 'answer'").repartition(buckets, "batch").groupBy("batch").agg(F.collect_list(F.struct("part", "a", "b", "c", "d")).alias(column))

    def used(*tables: str) -> None:
        for table in () if keep else tables:
            deleted(spark, f"{path}/{table}")

    # each table of batches has what later steps need, and what it was made of goes
    batches = bucketed(own.mapInArrow(settled(_batches), BATCHES), "batches")
    unigrams = asked(batches.select("batch", "words", "counts").mapInArrow(settled(_word_blocks(n)), BLOCKS), _unigrams(n), "unigrams")
    numbered = bucketed(batches.drop("counts").join(by_batch(unigrams, "words_answers").hint("shuffle_merge"), "batch", "left").mapInArrow(settled(_numbered(n)), NUMBERED), "numbered")
    used("batches", "unigrams/kind=answer")
    bigrams = asked(numbered.mapInArrow(settled(_bigram_blocks(n)), BLOCKS), _bigrams(top_counts(unigrams, n)), "bigrams")
    pairs = bucketed(by_batch(bigrams, "pairs_answers"), "pairs")
    used("bigrams/kind=answer")
    model = Model.of(totals(unigrams), totals(bigrams))
    known = numbered.join(pairs.hint("shuffle_merge"), "batch", "left")
    for turn in range(PASSES):
        trigrams = asked(known.mapInArrow(settled(_trigram_blocks(model, n, turn)), BLOCKS), _trigrams, "trigrams", turn)
    three = cut_discounts(totals(trigrams)[2:])
    return known.join(by_batch(trigrams, "triples_answers").hint("shuffle_merge"), "batch", "left").mapInArrow(settled(_scores(model, three, n)), SCORES)
