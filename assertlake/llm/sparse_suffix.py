"""Suffix-array dedup: passages of at least MIN_WORDS words that other documents hold too.

A word of a document is removed if it lies in a window of MIN_WORDS words that a document before it (by id) also holds, so of every
passage the first document's copy stays. Words are compared with A-Z in lower case. Repeats within one document stay.

1. Sparse suffixes. Of every window of MIN_WORDS words the k-gram with the least hash is its anchor: content picks it, so equal windows
   have it at the same place. Only suffixes at anchors are retained, and of these only those whose k-gram another text has too.
2. Suffix arrays. Retained suffixes with their context go to tasks by k-gram, are sorted, and neighbours compared: the common prefix
   of neighbours bounds classes of equal right sides. Matches are extended to the left word by word, which splits the classes. In each class of a
   whole window the first document keeps it.
3. A k-gram on more than HOT places is split by a longer one, the whole window: windows go to tasks by their hash, where each batch has sorted and
   aggregated its own; these are sorted again and neighbours compared, then the windows themselves stream past. The rows are the same.
4. Windows merge into spans.

Tasks exchange blocks (arrays for a range of hashes). Where a key can be frequent, small blocks of each batch's distinct keys come first and tell
which keys matter; the full blocks follow and are read one by one, so a frequent key fills no task's memory.

Texts that are equal as a whole are one text, held by the smallest id; the other ids are copies, removed whole where they have MIN_WORDS words.
Words are compared by 32-bit hashes within a common k-gram of 64 bits; texts are known by a 64-bit hash.

Null, empty or short texts: no spans. Repeated rows (same id and text): one document. Equal ids of different texts: documents in the order of the
text's hash. Null id: comes last (and so does -2**63, the one long that has no place). Texts of any length. Empty table: no rows. Other
columns are passed on by without_repeats(), whatever their names, and ignored by the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from assertlake.llm.common import LOWER, SPACED, Words, fresh, mix, ngram_hashes, parts, ranges, saved, settled, slices

MIN_WORDS = 50
GRAM = 16
HOT = 20_000
#: k-grams that a window holds.
SPREAD = MIN_WORDS - GRAM + 1
#: A run of words whose places are packed with the hashes' high bits; longer texts are taken run by run, with overlap.
RUN = 1 << 23
PLACE = np.uint64((1 << 24) - 1)
CONTEXT = SPREAD - 1 + MIN_WORDS
#: Ids go one down, so that null has the greatest number and comes last.
NO_ID = (1 << 63) - 1


def anchors(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """k-gram hashes of the words, the places where windows start, and the anchor's place of each; none crosses from text to text."""
    grams = ngram_hashes(h, GRAM)
    size = np.diff(first)
    starts = ranges(first[:-1], np.maximum(0, size - MIN_WORDS + 1))
    if not len(starts):
        return grams, starts, starts
    at = np.empty(len(grams) - SPREAD + 1, np.int64)
    for begin in range(0, len(at), RUN):  # places within a run fit below the hash
        own = grams[begin : begin + RUN + SPREAD - 1]
        least = (own & ~PLACE) | np.arange(len(own), dtype=np.uint64)
        width = 1
        while 2 * width <= SPREAD:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        rest = SPREAD - width
        least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
        at[begin : begin + RUN] = (least & PLACE).astype(np.int64) + begin
    return grams, starts, at[starts]


BLOCKS = "part int, kind int, t long, doc long, n long, a binary, b binary, c binary, d binary, e binary, f binary, g binary"
NAMES = [x.split()[0] for x in BLOCKS.split(", ")]
#: Kinds of rows: a text; what a batch has once for a key; other keys with what the batch aggregates; their arrays; suffixes with context.
TEXT, SINGLES, KEYS, FULL, SUFFIXES = range(5)


def block_rows(records: list[tuple]) -> pa.RecordBatch:
    """(part, kind, arrays) as rows."""
    blobs = [[(r[2][k].tobytes() if k < len(r[2]) else None) for r in records] for k in range(7)]
    none = pa.nulls(len(records), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in records], pa.int32()), pa.array([r[1] for r in records], pa.int32()), none, none, none, *(pa.array(x, pa.binary()) for x in blobs)], NAMES)


def dealt(keys: np.ndarray, n_parts: int, kind: int, arrays: list[np.ndarray]) -> list[tuple]:
    """The arrays by part of the keys' hash."""
    part = (mix(keys.view(np.uint64)) % np.uint64(n_parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    cut = np.searchsorted(part[order], np.arange(n_parts + 1))
    return [(p, kind, [x[order[cut[p] : cut[p + 1]]] for x in arrays]) for p in range(n_parts) if cut[p] < cut[p + 1]]


def by_part(batches: Iterator[pa.RecordBatch], dtypes: dict[int, list]) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """(part, kind, arrays) of blocks one by one; rows come sorted by part and kind."""
    for batch in batches:
        for i in range(batch.num_rows):
            kind = batch.column("kind")[i].as_py()
            yield batch.column("part")[i].as_py(), kind, [np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in zip("abcdefg", dtypes[kind])]


def _anchors(n_parts: int):
    """A row for each text, and blocks of anchors: those whose k-gram is once in the batch; of others the k-grams with their least and greatest text
    and their number, and all places."""

    def blocks(held: list[tuple]) -> pa.RecordBatch:
        gram, t, pos = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(gram, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], gram[order][1:] != gram[order][:-1]]))
        gram, t, pos = gram[order], t[order], pos[order]
        count = np.diff(np.append(first, len(gram)))
        once, many = first[count == 1], np.repeat(count > 1, count)
        out = dealt(gram[once], n_parts, SINGLES, [gram[once], t[once], pos[once].astype(np.int32)])
        if many.any():
            gram, t, pos, count = gram[many], t[many], pos[many], count[count > 1]
            first = np.cumsum(count) - count
            keys = [gram[first], np.minimum.reduceat(t, first), np.maximum.reduceat(t, first), count]
            out += dealt(keys[0], n_parts, KEYS, keys) + dealt(gram, n_parts, FULL, [gram, t, pos])
        return block_rows(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for i, j, data, offsets in slices(batch.column("text")):
                words = Words(LOWER[data], offsets, SPACED)
                t, n = batch.column("t").slice(i, j - i), j - i
                yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int32()), pa.array(np.zeros(n, np.int32)), t, batch.column("doc").slice(i, n), pa.array(np.diff(words.first)), *(pa.nulls(n, pa.binary()) for _ in range(7))], NAMES)
                grams, _, at = anchors(words.hashes(), words.first)
                at = np.unique(at)
                if not len(at):
                    continue
                doc = np.searchsorted(words.first, at, "right") - 1
                held.append((grams[at].view(np.int64), t.to_numpy()[doc], at - words.first[doc]))
                size += len(at)
                if size > 500_000:
                    yield blocks(held)
                    held, size = [], 0
        if size:
            yield blocks(held)

    return run


def _retained(n_parts: int, hot: int):
    """The places whose k-gram several texts have, in blocks by text: t, place, whether the k-gram is frequent."""

    def kept(known: np.ndarray, frequent: np.ndarray, gram: np.ndarray, t: np.ndarray, pos: np.ndarray) -> Iterator[pa.RecordBatch]:
        at = np.searchsorted(known, gram)
        at[at == len(known)] = 0
        on = known[at] == gram if len(known) else np.zeros(len(gram), bool)
        if on.any():
            yield block_rows(dealt(t[on], n_parts, FULL, [t[on], pos[on].astype(np.int64), frequent[at[on]].astype(np.int64)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, singles, keys, known = None, [], [], None

        def learn() -> tuple[np.ndarray, np.ndarray]:
            whole = [[g, t, t, np.ones(len(g), np.int64)] for g, t, _ in singles] + keys
            gram, low, high, n = (np.concatenate(x) for x in zip(*whole))
            order = np.argsort(gram, kind="stable")
            gram, low, high, n = (x[order] for x in (gram, low, high, n))
            first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
            shared = np.minimum.reduceat(low, first) != np.maximum.reduceat(high, first)
            return gram[first][shared], (np.add.reduceat(n, first) > hot)[shared]

        def finish() -> Iterator[pa.RecordBatch]:
            told = known if known is not None else learn() if singles or keys else None
            if told and singles:
                yield from kept(*told, *(np.concatenate(x) for x in zip(*singles)))

        for p, kind, arrays in by_part(batches, {SINGLES: [np.int64, np.int64, np.int32], KEYS: [np.int64] * 4, FULL: [np.int64] * 3}):
            if p != part:
                yield from finish()
                part, singles, keys, known = p, [], [], None
            if kind == SINGLES:
                singles.append(arrays)
            elif kind == KEYS:
                keys.append(arrays)
            else:
                known = known if known is not None else learn()
                yield from kept(*known, *arrays)
        yield from finish()

    return run


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(t, places, hot places), each once, for each text with retained anchors."""
    part, held = None, []

    def flush() -> pa.RecordBatch:
        t, pos, hot = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((pos, t))
        t, pos, hot = t[order], pos[order], hot[order]
        once = np.concatenate([[True], (t[1:] != t[:-1]) | (pos[1:] != pos[:-1])])
        t, pos, hot = t[once], pos[once], hot[once]
        texts_ = t[np.concatenate([[True], t[1:] != t[:-1]])]
        lists = [pa.ListArray.from_arrays(pa.array(np.append(np.searchsorted(t[hot == k], texts_), np.count_nonzero(hot == k)).astype(np.int32)), pa.array(pos[hot == k])) for k in (0, 1)]
        return pa.RecordBatch.from_arrays([pa.array(texts_), *lists], ["t", "places", "hot_places"])

    for p, _, arrays in by_part(batches, {FULL: [np.int64] * 3}):
        if p != part and held:
            yield flush()
            held = []
        part = p
        held.append(arrays)
    if held:
        yield flush()


def _contexts(n_parts: int):
    """Rows (t, doc, text, places and hot places of retained anchors) -> blocks of suffixes with their context, by k-gram; and for hot places the
    windows that they anchor, by the windows' hash: first the distinct ones with their first holder and texts, then all."""

    def blocks(suffixes: list[tuple], windows: list[tuple]) -> pa.RecordBatch:
        out = []
        if suffixes:
            arrays = [np.concatenate(x) for x in zip(*suffixes)]
            out += dealt(arrays[0], n_parts, SUFFIXES, arrays)
        if windows:
            window, t, doc, start = (np.concatenate(x) for x in zip(*windows))
            order = np.lexsort((t, doc, window))
            w, own = window[order], t[order]
            first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
            keys = [w[first], doc[order][first], own[first], np.minimum.reduceat(own, first), np.maximum.reduceat(own, first)]
            out += dealt(keys[0], n_parts, KEYS, keys) + dealt(window, n_parts, FULL, [window, t, doc, start])
        return block_rows(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        suffixes, windows, size = [], [], 0
        for batch in batches:
            for i, j, data, offsets in slices(batch.column("text")):
                words = Words(LOWER[data], offsets, SPACED)
                h, first = words.hashes(), words.first
                grams, starts, at = anchors(h, first)
                if not len(at):
                    continue
                t, ids = (batch.column(c).slice(i, j - i).to_numpy() for c in ("t", "doc"))
                run_first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
                run_last = np.append(run_first[1:], len(at)) - 1

                def asked(column: str, first=first, at=at, run_first=run_first, i=i, j=j, batch=batch) -> np.ndarray:
                    own = batch.column(column).slice(i, j - i)
                    return np.isin(at[run_first], own.flatten().to_numpy() + np.repeat(first[:-1], np.diff(own.offsets.to_numpy())))

                on = asked("places")
                if on.any():
                    place = at[run_first[on]]
                    doc = np.searchsorted(first, place, "right") - 1
                    near = np.clip(place[:, None] + np.arange(-(SPREAD - 1), MIN_WORDS), 0, len(h) - 1)
                    suffixes.append((grams[place].view(np.int64), t[doc], ids[doc], place - first[doc], place - starts[run_last[on]], place - starts[run_first[on]], h.astype(np.uint32)[near]))
                    size += 10 * len(place)
                on = asked("hot_places")
                if on.any():
                    begin = starts[ranges(run_first[on], (run_last - run_first + 1)[on])]
                    doc = np.searchsorted(first, begin, "right") - 1
                    windows.append((ngram_hashes(h, MIN_WORDS)[begin].view(np.int64), t[doc], ids[doc], begin - first[doc]))
                    size += len(begin)
                if size > 500_000:
                    yield blocks(suffixes, windows)
                    suffixes, windows, size = [], [], 0
        if size:
            yield blocks(suffixes, windows)

    return run


def spans(t: np.ndarray, doc: np.ndarray, start: np.ndarray, end: np.ndarray, removed: np.ndarray, source: np.ndarray) -> list[np.ndarray]:
    """Spans that overlap or touch become one with the smallest source, removed ones and others apart."""
    order = np.lexsort((start, removed, t))
    t, doc, start, end, removed, source = (x[order] for x in (t, doc, start, end, removed, source))
    group = np.cumsum(np.concatenate([[0], (t[1:] != t[:-1]) | (removed[1:] != removed[:-1])]))
    wide = int(end.max()) + 2 if len(end) else 1
    reach = np.maximum.accumulate(group * wide + end)
    at = np.flatnonzero(np.concatenate([[True], group[1:] * wide + start[1:] > reach[:-1]]))
    last = np.append(at[1:], len(t)) - 1
    return [t[at], doc[at], start[at], reach[last] - group[last] * wide, removed[at], np.minimum.reduceat(source, at)]


def repeated(gram: np.ndarray, t: np.ndarray, doc: np.ndarray, pos: np.ndarray, least: np.ndarray, most: np.ndarray, context: np.ndarray) -> list[np.ndarray] | None:
    """The suffix array of retained suffixes, and the spans of the windows that several texts hold."""
    left, right = context[:, SPREAD - 2 :: -1], context[:, SPREAD - 1 :]
    key = np.concatenate([gram.view(np.uint64).astype(">u8")[:, None].view(np.uint8), np.ascontiguousarray(right).astype(">u4").view(np.uint8)], axis=1)
    order = np.argsort(np.ascontiguousarray(key).view(f"S{key.shape[1]}")[:, 0], kind="stable")
    gram, t, doc, pos, least, most, left, right = (x[order] for x in (gram, t, doc, pos, least, most, left, right))
    differs = right[1:] != right[:-1]
    common = np.where(differs.any(1), differs.argmax(1), MIN_WORDS)  # the common prefix with the suffix before
    common = np.concatenate([[-1], np.where(gram[1:] == gram[:-1], common, -1)])
    rank = np.lexsort((t, doc))
    at = np.empty(len(rank), np.int64)
    at[rank] = np.arange(len(rank))
    out = []
    before = np.zeros(len(gram), np.uint64)
    for o in range(SPREAD):  # words of the window that are left of the anchor
        if o:
            before = mix(before * np.uint64(3) + left[:, o - 1].astype(np.uint64))
        on = np.flatnonzero((least <= o) & (o <= most))
        if len(on) < 2:
            continue
        same_right = np.cumsum(common < MIN_WORDS - o)
        group = mix(before[on] ^ mix(same_right[on].astype(np.uint64)))
        inner = np.lexsort((at[on], group))
        on, group = on[inner], group[inner]
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        size = np.diff(np.append(first, len(on)))
        holder = np.repeat(on[first], size)
        several = np.repeat(np.maximum.reduceat(t[on] != t[holder], first), size)
        on, holder = on[several], holder[several]
        if len(on):
            out.append((t[on], doc[on], pos[on] - o, pos[on] - o + MIN_WORDS, (t[on] != t[holder]).astype(np.int64), doc[holder]))
    return spans(*(np.concatenate(x) for x in zip(*out))) if out else None


def _repeats(n_parts: int):
    """Span blocks by text, of the windows that several texts hold."""

    def sorted_out(held: list[list[np.ndarray]]) -> Iterator[list[np.ndarray]]:
        whole = [np.concatenate(x) for x in zip(*held)]
        order = np.argsort(whole[0], kind="stable")
        gram = whole[0][order]
        first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
        begin = 0
        for end in [*first[1:][np.diff(first // HOT) > 0].tolist(), len(gram)]:  # whole k-grams, about HOT rows at a time
            if begin < end and (out := repeated(*(x[order[begin:end]] for x in whole))) is not None:
                yield out
            begin = end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, keys, known = None, [], [], None
        send = lambda out: block_rows(dealt(out[0], n_parts, FULL, out))

        def finish() -> Iterator[pa.RecordBatch]:
            if held:
                for out in sorted_out(held):
                    yield send(out)

        for p, kind, arrays in by_part(batches, {SUFFIXES: [np.int64] * 6 + [np.uint32], KEYS: [np.int64] * 5, FULL: [np.int64] * 4}):
            if p != part:
                yield from finish()
                part, held, keys, known = p, [], [], None
            if kind == SUFFIXES:
                held.append([*arrays[:6], arrays[6].reshape(-1, CONTEXT)])
            elif kind == KEYS:
                keys.append(arrays)
            else:
                if known is None:
                    window, doc, t, low, high = (np.concatenate(x) for x in zip(*keys))
                    order = np.lexsort((t, doc, window))
                    window, doc, t, low, high = (x[order] for x in (window, doc, t, low, high))
                    first = np.flatnonzero(np.concatenate([[True], window[1:] != window[:-1]]))
                    several = np.minimum.reduceat(low, first) != np.maximum.reduceat(high, first)
                    known, holder_doc, holder_t, keys = (*(x[first][several] for x in (window, doc, t)), [])
                window, t, doc, start = arrays
                at = np.searchsorted(known, window)
                at[at == len(known)] = 0
                on = np.flatnonzero(known[at] == window) if len(known) else np.zeros(0, np.int64)
                if len(on):
                    at = at[on]
                    yield send(spans(t[on], doc[on], start[on], start[on] + MIN_WORDS, (t[on] != holder_t[at]).astype(np.int64), holder_doc[at]))
        yield from finish()

    return run


SPANS = "t long, doc long, start long, end long, removed boolean, source long"


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The spans of each text."""
    part, held = None, []

    def flush() -> pa.RecordBatch:
        out = spans(*(np.concatenate(x) for x in zip(*held)))
        out[4] = out[4].astype(bool)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in out], [x.split()[0] for x in SPANS.split(", ")])

    for p, _, arrays in by_part(batches, {FULL: [np.int64] * 6}):
        if p != part and held:
            yield flush()
            held = []
        part = p
        held.append(arrays)
        if len(held) >= 64:  # pieces of one span are many
            held = [spans(*(np.concatenate(x) for x in zip(*held)))]
    if held:
        yield flush()


def texts(docs: DataFrame) -> DataFrame:
    """(t, doc, text): t is the hash of the text, doc the id's number."""
    return docs.select(*numbered(), F.coalesce("text", F.lit("")).alias("text"))


def numbered(t: str = "t", doc: str = "doc") -> list[Column]:
    return [F.xxhash64(F.coalesce("text", F.lit(""))).alias(t), F.coalesce(F.try_subtract(F.col("doc_id").cast("long"), F.lit(1).cast("long")), F.lit(NO_ID)).alias(doc)]


def doc_id(doc: str) -> Column:
    return F.when(F.col(doc) != NO_ID, F.col(doc) + 1)


def duplicate_spans(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(t, doc, start, end, removed, source), spans in words, end excluded. removed: a document before holds the passage too; source: the
    first that does. Spans that are not removed are those from which others are."""
    n = parts(docs.sparkSession, docs)
    own = texts(docs)
    rows = saved(own.mapInArrow(settled(_anchors(n)), BLOCKS), "suffix-anchors")
    together = lambda df: df.repartitionById(n, F.col("part")).sortWithinPartitions("part", "kind")
    each = rows.where("part is null").select("t", "doc", "n").where(F.col("n") >= MIN_WORDS)
    firsts = each.groupBy("t").agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
    retained = together(rows.where("part is not null")).mapInArrow(settled(_retained(n, hot)), BLOCKS)
    places = together(retained).mapInArrow(settled(_places), "t long, places array<long>, hot_places array<long>")
    asked = places.join(firsts.select("t", F.col("first").alias("doc")), "t")
    # by merge at any size: the plan is to be the same for small tables and large ones
    found = own.join(asked.hint("merge"), ["t", "doc"]).select("t", "doc", "text", "places", "hot_places").mapInArrow(settled(_contexts(n)), BLOCKS)
    merged = together(together(found).mapInArrow(settled(_repeats(n)), BLOCKS)).mapInArrow(settled(_merged), SPANS)
    copies = each.distinct().join(firsts.where(F.col("first") < F.col("last")).select("t", "first"), "t")
    whole = copies.select("t", "doc", F.lit(0).cast("long").alias("start"), F.col("n").alias("end"), (F.col("doc") != F.col("first")).alias("removed"), F.col("first").alias("source"))
    return merged.unionByName(whole)


def reported(docs: DataFrame) -> DataFrame:
    """doc_id, start_word, end_word, removed, source_doc_id: a row for each span of a repeated passage."""
    out = duplicate_spans(docs)
    return out.select(doc_id("doc").alias("doc_id"), F.col("start").alias("start_word"), F.col("end").alias("end_word"), "removed", doc_id("source").alias("source_doc_id"))


def _cut(carry: list[str], spans_: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts_ = batch.column("text").to_pylist()
            for i, own in enumerate(batch.column(spans_).to_pylist()):
                if own:
                    raw = (texts_[i] or "").encode()
                    words = Words(LOWER[np.frombuffer(raw, np.uint8)], np.array([0, len(raw)]), SPACED)
                    kept, at = [], 0
                    for s in sorted(own, key=lambda x: (x["start"], x["end"])):
                        kept.append(raw[at : max(at, int(words.start[s["start"]]))])
                        at = max(at, int(words.end[s["end"] - 1]))
                    texts_[i] = b"".join([*kept, raw[at:]]).decode()
            columns = [pa.array(texts_, batch.schema.field("text").type) if c == "text" else batch.column(c) for c in carry]
            yield pa.RecordBatch.from_arrays(columns, carry)

    return run


def without_repeats(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all columns, without the words of removed spans; a row that loses all its words goes. Null and empty texts stay."""
    t, doc, spans_, cut = fresh(docs.columns, "__t", "__doc", "__spans", "__cut")
    gone = duplicate_spans(docs.select("doc_id", "text")).where("removed").groupBy(F.col("t").alias(t), F.col("doc").alias(doc)).agg(F.collect_list(F.struct("start", "end")).alias(spans_))
    rows = docs.select("*", *numbered(t, doc)).join(gone, [t, doc], "left").select(*docs.columns, spans_, F.col(spans_).isNotNull().alias(cut))
    schema = T.StructType([*docs.schema.fields, T.StructField(cut, T.BooleanType())])
    out = rows.mapInArrow(settled(_cut([*docs.columns, cut], spans_)), schema)
    return out.where(~F.col(cut) | F.col("text").rlike(r"[^\x20\x09-\x0D]")).drop(cut)


def oracle(least: int = MIN_WORDS) -> str:
    """reported() in DuckDB's SQL: windows of words joined by their text. Of equal ids the smaller text comes first."""
    return rf"""
WITH d AS (SELECT DISTINCT doc_id, coalesce(text, '') AS text FROM documents),
f AS (SELECT text, min(doc_id) AS first, max(doc_id) AS last, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d GROUP BY text),
w AS (SELECT first AS doc, text, i - 1 AS s, array_to_string(w[i : i + {least - 1}], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - {least - 2})) AS i FROM f WHERE len(w) >= {least})),
h AS (SELECT g, arg_min(text, struct_pack(d := doc, t := text)) AS holder, min(doc) AS source FROM w GROUP BY g HAVING count(DISTINCT text) > 1),
m AS (SELECT doc, s, s + {least} AS e, text <> holder AS removed, source FROM w JOIN h USING (g)),
n AS (SELECT *, coalesce(s > max(e) OVER (PARTITION BY doc, removed ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS new FROM m),
i AS (SELECT *, sum(new::INT) OVER (PARTITION BY doc, removed ORDER BY s) AS k FROM n)
SELECT doc AS doc_id, min(s) AS start_word, max(e) AS end_word, removed, min(source) AS source_doc_id FROM i GROUP BY doc, removed, k
UNION ALL SELECT doc_id, 0, len(w), doc_id <> first, first FROM d JOIN f USING (text) WHERE first < last AND len(w) >= {least}
"""
