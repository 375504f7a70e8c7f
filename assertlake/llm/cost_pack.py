"""Cost-balanced packing of documents into training sequences.

A task tokenises the documents it reads and packs them pool by pool (POOL_TOKENS at a time), so nothing is
shuffled and memory is bounded. In a pool, whole windows of SEQUENCE tokens are cut off long documents; what
remains of each document is taken in descending length, and goes to the sequence with the lowest
estimated cost (linear plus quadratic in the length of each piece) among those with the capacity left.
There are just as many sequences as the tokens need; a remainder that fits nowhere whole is cut over the
sequences with most room. So a pool pads less than one sequence. A sequence is as long as what it holds
where that is a power of two, else it is padded to SEQUENCE.

A text is tokenised word by word between blanks and newlines, which the tokeniser splits at anyway; a worker keeps the ids
of up to CACHED_WORDS words. sequence_id = partition number * 2**32 + number there.

Null text: empty; its one id is the end id. Repeated rows or ids: each row is a document. Empty table: no rows.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from assertlake.llm.common import KEPT, Words, ranges, settled, slices

SEQUENCE = 2048
END_ID = 1
POOL_TOKENS = 1 << 21
CACHED_WORDS = 1_500_000
#: A special token of the tokeniser; it ends a word in a run.
MARK = "<|endoftext|>"
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[10, 32]] = False
#: Cost of a piece of n tokens: n + QUADRATIC * n * n; at SEQUENCE attention costs as much as the rest.
QUADRATIC = 1 / SEQUENCE

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long, sequence_cost double"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokenizer:
    """ids(bytes, offsets): the tokeniser's ids of each text, end to end, and how many there are of each.

    Known words are kept by a 64-bit hash: a large sorted table and a small one of new words, merged now and then.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        self.mark = self.encoder.token_to_id(MARK)
        self.clear()

    def clear(self) -> None:
        none = np.zeros(0, np.int64)
        self.tables = [(none.astype(np.uint64), none, none), (none.astype(np.uint64), none, none)]
        self.flat = np.zeros(0, np.uint32)

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, end to end, and their counts: words go in runs, with a special token after each."""
        odd = [i for i, w in enumerate(words) if MARK[:2] in w]
        plain = [w if MARK[:2] not in w else "" for w in words]
        runs = [MARK.join(plain[i : i + 2000]) + MARK for i in range(0, len(plain), 2000)]
        found = [np.array(e.ids, np.uint32) for i in range(0, len(runs), 8) for e in self.encoder.encode_batch_fast(runs[i : i + 8], add_special_tokens=False)]
        ids = np.concatenate(found)
        marks = np.flatnonzero(ids == self.mark)
        count = np.diff(np.concatenate([[-1], marks])) - 1
        ids = np.delete(ids, marks)
        if odd:
            at = np.concatenate([[0], np.cumsum(count)])
            own = [ids[at[i] : at[i + 1]] for i in range(len(words))]
            for i in odd:
                own[i] = np.array(self.encoder.encode(words[i], add_special_tokens=False).ids, np.uint32)
            ids, count = np.concatenate(own), np.array([len(x) for x in own])
        return ids, count

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of words start, -1 for new ones, and how many they are."""
        first, count = np.full(len(h), -1), np.zeros(len(h), np.int64)
        for hashes, starts, counts in self.tables:
            if len(hashes):
                at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                same = hashes[at] == h
                first[same], count[same] = starts[at[same]], counts[at[same]]
        return first, count

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        words = Words(data, offsets, NOT_BLANK)
        h, where, at = np.unique(words.hashes(), return_index=True, return_inverse=True)
        if len(self.tables[0][0]) + len(self.tables[1][0]) + len(h) > CACHED_WORDS or len(self.flat) > 8 * CACHED_WORDS:
            self.clear()
        first, count = self.find(h)
        new = np.flatnonzero(first < 0)
        if len(new):
            raw = data.tobytes()
            found, n = self.encode([raw[a:b].decode() for a, b in zip(words.start[where[new]].tolist(), words.end[where[new]].tolist())])
            first[new], count[new] = len(self.flat) + np.cumsum(n) - n, n
            self.flat = np.concatenate([self.flat, found])
            self.tables[1] = self.merged(self.tables[1], (h[new], first[new], n))
            if 4 * len(self.tables[1][0]) > len(self.tables[0][0]):
                self.tables = [self.merged(*self.tables), tuple(x[:0] for x in self.tables[1])]
        n = count[at]
        total = np.concatenate([[0], np.cumsum(n)])
        return self.flat[ranges(first[at], n)], np.diff(total[words.first])

    @staticmethod
    def merged(*tables: tuple) -> tuple:
        columns = [np.concatenate(x) for x in zip(*tables)]
        order = np.argsort(columns[0], kind="stable")
        return tuple(x[order] for x in columns)


def tokenizer(path: str) -> WordTokenizer:
    """One for each worker process, with the words that it knows, as long as packing goes on there."""
    kept = KEPT.setdefault("tokenizer", {})
    if path not in kept:
        kept[path] = WordTokenizer(path)
    return kept[path]


def pack(length: np.ndarray, sequence: int = SEQUENCE, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """(document, start, piece length, sequence number, offset) for documents of the given lengths, none of them 0."""
    out, number = [], 0
    whole = length // sequence
    for d in np.flatnonzero(whole):
        for k in range(whole[d]):
            out.append((int(d), int(k) * sequence, sequence, number, 0))
            number += 1
    rest = length % sequence
    n_open = int(-(-rest.sum() // sequence))
    room = np.full(n_open, sequence, np.int64)
    cost = np.zeros(n_open)
    base = number

    def put(d: int, start: int, n: int, s: int) -> None:
        out.append((d, start, n, base + s, int(sequence - room[s])))
        room[s] -= n
        cost[s] += n + quadratic * n * n

    for d in np.argsort(-rest, kind="stable"):
        n, start = int(rest[d]), int(whole[d]) * sequence
        if not n:
            break
        fits = np.where(room >= n, cost, np.inf)
        s = int(np.argmin(fits))
        if fits[s] < np.inf:
            put(int(d), start, n, s)
            continue
        while n:
            s = int(np.argmax(room))
            m = min(n, int(room[s]))
            put(int(d), start, m, s)
            n, start = n - m, start + m
    return out


def _packer(path: str, sequence: int, end_id: int, pool_tokens: int):
    def flush(first: int, doc_ids: list, ids: list[np.ndarray], length: list[np.ndarray]) -> tuple[pa.RecordBatch, int]:
        length = np.concatenate(length)
        flat = np.concatenate(ids)
        begin = np.concatenate([[0], np.cumsum(length)[:-1]])
        rows = np.array(pack(length, sequence), np.int64).reshape(-1, 5)
        doc, start, n, number, offset = rows.T
        raw = memoryview(flat.astype("<u4").tobytes())
        crc = [zlib.crc32(raw[a : a + m]) for a, m in zip(((begin[doc] + start) * 4).tolist(), (n * 4).tolist())]
        n_sequences = int(number.max()) + 1
        held = np.bincount(number, n, n_sequences).astype(np.int64)
        padded = np.where(held & (held - 1) == 0, held, sequence)
        cost = np.bincount(number, n + QUADRATIC * n * n, n_sequences)
        columns = [pa.concat_arrays(doc_ids).take(pa.array(doc)), start, n, np.array(crc, np.int64), length[doc], first + number, offset, padded[number], cost[number]]
        return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], [x.split()[0] for x in PIECES.split(", ")]), first + n_sequences

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokenizer(path)
        at = TaskContext.get().partitionId() << 32
        doc_ids, ids, length, tokens = [], [], [], 0
        for batch in batches:
            for i, j, data, offsets in slices(batch.column("text")):
                flat, n = words.ids(data, offsets)
                doc_ids.append(batch.column("doc_id").slice(i, j - i))
                ids.append(np.insert(flat, np.cumsum(n), np.uint32(end_id)))
                length.append(n + 1)
                tokens += len(ids[-1])
                if tokens >= pool_tokens:
                    out, at = flush(at, doc_ids, ids, length)
                    yield out
                    doc_ids, ids, length, tokens = [], [], [], 0
        if tokens:
            yield flush(at, doc_ids, ids, length)[0]

    return run


def packed(docs: DataFrame, path: str | None = None, sequence: int = SEQUENCE, end_id: int = END_ID, pool_tokens: int = POOL_TOKENS) -> DataFrame:
    """A row for each piece, columns PIECES; path: the tokeniser's file, the same on all machines."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(settled(_packer(path or tokenizer_path(), sequence, end_id, pool_tokens), "tokenizer"), PIECES)
