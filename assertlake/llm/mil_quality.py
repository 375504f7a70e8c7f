"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of about PASSAGE words. Each passage is encoded (character classes, word shapes, repetition, and what
of the document repeats), a learned layer turns the encoding into a state, gated attention weighs the states of a document's passages, and the
weighted sum gives the score. All weights are learned together from document labels.

The fit takes labelled documents in the order of a hash of their id: at most SAMPLE_ROWS, as many as have SAMPLE_PASSAGES passages together, each
with all its passages; so what reaches the driver is bounded. Scoring takes every passage of every text and shuffles nothing.

Null or empty text: one empty passage, scored like any. Null doc_id: remainder 0, so held out. Repeated rows: each gives a row; of several texts of
one id the fit takes the one with the least hash. Several labels of a document: their majority; a tie gives no label. No label of one kind at
all: every score is the share of label 1 (1.0 without any label). Empty table: no rows. Other columns, whatever their names, are carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from assertlake.llm.common import LOWER, SPACED, Words, fresh, mix, ranges, saved, settled, slices

PASSAGE = 64
SAMPLE_ROWS = 5000
SAMPLE_PASSAGES = 1 << 20
HIDDEN, ATTENTION = 24, 16
EPOCHS, BATCH, RATE, DECAY = 40, 256, 0.01, 1e-4
THRESHOLD = 0.3

#: Classes of bytes: other, upper, digit, symbol, exclamation and question, stop and comma, other punctuation, newline, beyond ASCII.
CLASSES = np.zeros(256, np.int64)
CLASSES[65:91] = 1
CLASSES[48:58] = 2
CLASSES[[ord(c) for c in "#*$%&|<>"]] = 3
CLASSES[[33, 63]] = 4
CLASSES[[44, 46]] = 5
CLASSES[[c for c in range(34, 127) if not chr(c).isalnum() and chr(c) not in "#*$%&|<>?,."]] = 6
CLASSES[10] = 7
CLASSES[128:] = 8
N_CLASSES = 9
FEATURES = N_CLASSES + 9


def encoded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The encodings of all passages, and how many each text has (one at least)."""
    words = Words(data, offsets, SPACED)
    n_words = np.diff(words.first)
    n_passages = np.maximum(1, (n_words + PASSAGE // 2) // PASSAGE)
    total = int(n_passages.sum())
    out = np.zeros((total, FEATURES))
    doc = np.repeat(np.arange(len(n_words)), n_passages)
    nth = ranges(np.zeros(len(n_words), np.int64), n_passages)
    begin = words.first[:-1][doc] + n_words[doc] * nth // n_passages[doc]
    stop = words.first[:-1][doc] + n_words[doc] * (nth + 1) // n_passages[doc]
    size = stop - begin
    passage = np.repeat(np.arange(total), size)  # of each word; passages are in the order of words
    if len(passage):
        h = Words(LOWER[data], offsets, SPACED).hashes()
        on = np.flatnonzero(size)
        at = np.zeros(total + 1, np.int64)  # bytes: from a passage's first word to the next passage's
        at[:-1] = np.where(size > 0, words.start[np.minimum(begin, len(words.start) - 1)], 0)
        low, high = at[on], words.end[stop[on] - 1]
        span = high - low
        owner = np.repeat(on, span)
        counts = np.bincount(owner * N_CLASSES + CLASSES[data[ranges(low, span)]], minlength=total * N_CLASSES).reshape(total, N_CLASSES)
        out[on, :N_CLASSES] = np.log1p(100 * counts[on] / span[:, None])
        length = words.end - words.start
        mean = np.bincount(passage, length, total)[on] / size[on]
        out[on, N_CLASSES] = mean
        out[on, N_CLASSES + 1] = np.sqrt(np.maximum(0, np.bincount(passage, length * length, total)[on] / size[on] - mean * mean))
        out[on, N_CLASSES + 2] = np.bincount(passage, length == 1, total)[on] / size[on]
        for k, gram in ((3, h), (4, mix(h + np.roll(h, -1) * np.uint64(3)))):
            distinct = np.unique(mix(gram ^ mix(passage.astype(np.uint64) + np.uint64(1))), return_index=True)[1]
            out[on, N_CLASSES + k] = np.bincount(passage[distinct], minlength=total)[on] / size[on]
        out[on, N_CLASSES + 5] = np.log1p(size[on])
    out[:, N_CLASSES + 6] = np.log1p(n_words)[doc]
    # of the whole document: the share of distinct words against what its length lets expect, the share of repeated lines
    if len(words.start):
        word_doc = words.doc
        distinct = np.unique(mix(h ^ mix(word_doc.astype(np.uint64) + np.uint64(7))), return_index=True)[1]
        share = np.bincount(word_doc[distinct], minlength=len(n_words)) / np.maximum(1, n_words)
        out[:, N_CLASSES + 7] = (np.log(np.maximum(share, 1e-4)) * (n_words > 0))[doc]
        newline = np.concatenate([[True], np.diff(np.cumsum(data == 10)[words.start]) > 0])
        newline[words.first[:-1][n_words > 0]] = True
        first = np.flatnonzero(newline)
        line = np.add.reduceat(mix(h + np.uint64(11) * (np.arange(len(h)) - np.repeat(first, np.diff(np.append(first, len(h))))).astype(np.uint64)), first)
        line_doc = word_doc[first]
        distinct = np.unique(mix(line ^ mix(line_doc.astype(np.uint64) + np.uint64(7))), return_index=True)[1]
        n_lines = np.bincount(line_doc, minlength=len(n_words))
        out[:, N_CLASSES + 8] = (1 - np.bincount(line_doc[distinct], minlength=len(n_words)) / np.maximum(1, n_lines))[doc] * (n_lines > 0)[doc]
    return out, n_passages


class Model:
    """Weights by name, and the scale of the encodings."""

    def __init__(self, prior: float):
        self.prior, self.weights, self.mean, self.deviation = prior, None, None, None

    def start(self, x: np.ndarray, seed: int = 0) -> None:
        self.mean, self.deviation = x.mean(0), x.std(0) + 1e-3
        r = np.random.default_rng(seed)
        part = lambda a, b: r.normal(0, 1 / np.sqrt(a), (a, b))
        self.weights = {"w": part(FEATURES, HIDDEN), "b": np.zeros(HIDDEN), "v": part(HIDDEN, ATTENTION), "vb": np.zeros(ATTENTION), "u": part(HIDDEN, ATTENTION), "ub": np.zeros(ATTENTION), "a": part(ATTENTION, 1)[:, 0], "c": part(HIDDEN, 1)[:, 0], "d": np.array(np.log(max(self.prior, 1e-3) / max(1 - self.prior, 1e-3)))}

    def forward(self, x: np.ndarray, count: np.ndarray) -> dict:
        """x: encodings of passages, bag after bag; count: those in each bag."""
        k = self.weights
        first = np.concatenate([[0], np.cumsum(count)[:-1]])
        x = np.clip((x - self.mean) / self.deviation, -8, 8)
        h = np.tanh(x @ k["w"] + k["b"])
        t, g = np.tanh(h @ k["v"] + k["vb"]), 1 / (1 + np.exp(-(h @ k["u"] + k["ub"])))
        e = (t * g) @ k["a"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), count))
        attention = e / np.repeat(np.add.reduceat(e, first), count)
        z = np.add.reduceat(h * attention[:, None], first)
        score = 1 / (1 + np.exp(-np.clip(z @ k["c"] + k["d"], -30, 30)))
        return {"x": x, "h": h, "t": t, "g": g, "attention": attention, "z": z, "score": score}

    def gradients(self, f: dict, count: np.ndarray, y: np.ndarray) -> dict:
        k, out = self.weights, {}
        first = np.concatenate([[0], np.cumsum(count)[:-1]])
        s = (f["score"] - y) / len(y)
        out["c"], out["d"] = f["z"].T @ s, s.sum()
        dz = np.repeat(s[:, None] * k["c"], count, axis=0)
        att = f["attention"]
        da = (dz * f["h"]).sum(1)
        de = att * (da - np.repeat(np.add.reduceat(da * att, first), count))
        out["a"] = (f["t"] * f["g"]).T @ de
        dt = de[:, None] * k["a"] * f["g"] * (1 - f["t"] ** 2)
        dg = de[:, None] * k["a"] * f["t"] * f["g"] * (1 - f["g"])
        out["v"], out["vb"], out["u"], out["ub"] = f["h"].T @ dt, dt.sum(0), f["h"].T @ dg, dg.sum(0)
        dh = (dz * att[:, None] + dt @ k["v"].T + dg @ k["u"].T) * (1 - f["h"] ** 2)
        out["w"], out["b"] = f["x"].T @ dh, dh.sum(0)
        return out

    def fit(self, bags: list[np.ndarray], y: np.ndarray, epochs: int = EPOCHS) -> None:
        """Adam over shuffled batches of bags."""
        self.start(np.concatenate(bags))
        r, step = np.random.default_rng(1), 0
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.weights.items()}
        for epoch in range(epochs):
            order = r.permutation(len(bags))
            rate = RATE * (1 - epoch / epochs) + 1e-4
            for i in range(0, len(order), BATCH):
                own = order[i : i + BATCH]
                count = np.array([len(bags[j]) for j in own])
                f = self.forward(np.concatenate([bags[j] for j in own]), count)
                step += 1
                for name, g in self.gradients(f, count, y[own]).items():
                    m, v = moments[name]
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    self.weights[name] = self.weights[name] * (1 - rate * DECAY) - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    def score(self, x: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The score of each bag, and the place in its bag of the passage with the most attention."""
        if self.weights is None:
            return np.full(len(count), self.prior), np.zeros(len(count), np.int64)
        f = self.forward(x, count)
        first = np.concatenate([[0], np.cumsum(count)[:-1]])
        top = np.repeat(np.maximum.reduceat(f["attention"], first), count) == f["attention"]
        at = np.flatnonzero(top)
        return f["score"], at[np.searchsorted(at, first)] - first


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, offsets in slices(batch.column("text")):
            x, count = encoded(data, offsets)
            first = np.concatenate([[0], np.cumsum(count)[:-1]])
            bags = [x[a : a + n].astype(np.float32).tobytes() for a, n in zip(first.tolist(), count.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), batch.column("y").slice(i, j - i), pa.array(count.astype(np.int64)), pa.array(bags, pa.large_binary()).cast(pa.binary())], ["doc_id", "y", "n", "bag"])


def remainder():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5


def fitted(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_passages: int = SAMPLE_PASSAGES) -> Model:
    known = labels.where("quality in (0, 1) and doc_id is not null").where(remainder() != 0)
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("quality").alias("mean")).where("mean <> 0.5")
    known = known.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi")
    order = F.xxhash64("doc_id")
    known = known.select("doc_id", (F.col("mean") > 0.5).cast("double").alias("y")).orderBy(order, "doc_id").limit(sample_rows)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), "doc_id")
    own = own.groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("x")).select("doc_id", "y", "x.text")
    bags = saved(own.mapInArrow(settled(_sampled), "doc_id long, y double, n long, bag binary"), "mil-bags")
    sizes = bags.select("doc_id", "n").orderBy(order, "doc_id").collect()  # sample_rows at most
    taken = [r.doc_id for r, total in zip(sizes, np.cumsum([r.n for r in sizes])) if total <= sample_passages]
    rows = bags.where(F.col("doc_id").isin(taken)).collect() if taken else []
    rows.sort(key=lambda r: r.doc_id)
    y = np.array([r.y for r in rows])
    model = Model(float(y.mean()) if len(y) else 1.0)
    if 0 < y.sum() < len(y):
        model.fit([np.frombuffer(r.bag, np.float32).reshape(-1, FEATURES).astype(np.float64) for r in rows], y)
    return model


#: The columns that scoring adds, with more underscores where they clash.
SCORED = ["__mil_score", "__mil_passages", "__mil_top"]


def _scorer(model: Model, carry: list[str], added: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in slices(batch.column("text")):
                x, count = encoded(data, offsets)
                score, top = model.score(x, count)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in carry), pa.array(score), pa.array(count), pa.array(top)], [*carry, *added])

    return run


def scored(docs: DataFrame, model: Model, carry: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """The columns of docs that carry names (None: all) and those of SCORED; and what these are called."""
    carry = list(docs.columns if carry is None else carry)
    added = fresh(carry, *SCORED)
    schema = T.StructType([*(docs.schema[c] for c in carry), *(T.StructField(c, t) for c, t in zip(added, (T.DoubleType(), T.LongType(), T.LongType())))])
    return docs.select(*dict.fromkeys([*carry, "text"])).mapInArrow(settled(_scorer(model, carry, added)), schema), added


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, n_passages, top_passage; a row for each row of docs."""
    rows, added = scored(docs.select("doc_id", "text"), fitted(docs, labels), ["doc_id"])
    score, n, top = (F.col(c) for c in added)
    return rows.select("doc_id", (remainder() == 0).alias("held_out"), score.alias("score"), (score >= THRESHOLD).cast("int").alias("predicted"), n.alias("n_passages"), top.alias("top_passage"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that the classifier doesn't reject."""
    rows, added = scored(docs, fitted(docs, labels))
    return rows.where(F.col(added[0]) >= THRESHOLD).select(*docs.columns)
