"""The operators over documents against plain versions, with the odd cases of helpers.documents()."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from assertlake.llm import common, cost_pack, fm_decontaminate, graph, katz_lm, mil_quality, rule_filter, signature_join, sparse_suffix, tree_shard
from tests.llm import helpers as h


@pytest.fixture(scope="module")
def rows():
    return h.documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return h.frame(spark, rows).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return h.frame(spark, [])


# ---- shared pieces ----


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aB é\n\t%日"), max_size=30), max_size=8))
def test_words_are_those_of_split(texts):
    data, offsets = common.buffers(pa.array(texts, pa.string()))
    w = common.Words(common.LOWER[data], offsets, common.SPACED)
    got = [[bytes(common.LOWER[data][a:b]) for a, b in zip(w.start[i:j], w.end[i:j])] for i, j in zip(w.first[:-1], w.first[1:])]
    assert got == [h.words(t) for t in texts]
    hashes = w.hashes()
    flat = [x for own in got for x in own]
    assert len(set(zip(flat, hashes.tolist()))) == len(set(flat)) == len(set(hashes.tolist()))


def test_slices_cover_all_texts_once():
    texts = ["ab", None, "", "c" * 100, "dé"] * 7
    column = pa.array(texts, pa.string()).slice(2, 30)
    got = [bytes(data[a:b]).decode() for _, _, data, o in common.slices(column, 50) for a, b in zip(o[:-1], o[1:])]
    assert got == [t or "" for t in texts[2:32]]


def test_components(spark):
    r = random.Random(3)
    links = [(i, i + 1) for i in range(0, 200) if i % 17] + [(r.randrange(1000, 1200), r.randrange(1000, 1200)) for _ in range(150)] + [(5000 + i, 5000) for i in range(300)]
    up = {x: x for e in links for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    got = {x.node: x.root for x in graph.components(spark.createDataFrame(links, "a long, b long").repartition(5), "t").collect()}
    linked = {x for e in links if e[0] != e[1] for x in e}
    assert got == {x: find(x) for x in linked}
    assert graph.components(spark.createDataFrame([], "a long, b long"), "t").count() == 0


def test_components_of_a_long_chain(spark, monkeypatch):
    """A path over shuffled ids is one component, and takes rounds by the logarithm of its length."""
    names, rounds = random.Random(5).sample(range(10**6), 4000), []
    keep = graph.saved
    monkeypatch.setattr(graph, "saved", lambda df, name: rounds.append(name) or keep(df, name))
    links = spark.createDataFrame(list(zip(names, names[1:])), "a long, b long").repartition(5)
    got = {x.node: x.root for x in graph.components(links, "t").collect()}
    assert got == dict.fromkeys(names, min(names))
    assert len(rounds) < 30


# ---- 1: suffix-array dedup ----


@pytest.mark.parametrize("hot", [20_000, 1])
def test_removed_passages(docs, rows, hot):
    want = {}
    for (i, t), places in h.removed_words(rows).items():
        want.setdefault(i, set()).update(places)
    got = {}
    for r in sparse_suffix.duplicate_spans(docs, hot).where("removed").collect():
        got.setdefault(None if r.doc == sparse_suffix.NO_ID else r.doc + 1, set()).update(range(r.start, r.end))
    assert got == want and {5, 9, 10} <= set(got)


def test_texts_without_repeats(docs, rows, empty):
    out = sparse_suffix.without_repeats(docs)
    assert out.columns == docs.columns
    got = Counter((r.doc_id, tuple(h.words(r.text))) for r in out.collect())
    cut = h.removed_words(rows)
    want = Counter()
    for i, t in rows:
        gone = cut.get((i, t or ""), set())
        left = tuple(w for k, w in enumerate(h.words(t)) if k not in gone)
        if left or not gone:
            want[i, left] += 1
    assert got == want
    assert sparse_suffix.reported(empty).count() == 0 and sparse_suffix.without_repeats(empty).count() == 0


def test_anchors_of_a_text_longer_than_a_run(monkeypatch):
    h_ = np.random.default_rng(1).integers(0, 60, 5000).astype(np.uint64)
    want = sparse_suffix.anchors(h_, np.array([0, 3000, 5000]))
    monkeypatch.setattr(sparse_suffix, "RUN", 100)
    for a, b in zip(want, sparse_suffix.anchors(h_, np.array([0, 3000, 5000]))):
        assert np.array_equal(a, b)
    assert ((want[2] - want[1] >= 0) & (want[2] - want[1] < sparse_suffix.SPREAD)).all()


def test_greatest_id_and_clashing_names(spark):
    r, vocab = random.Random(9), h.vocabulary()
    text = h.prose(r, vocab, 90)
    rows = [((1 << 63) - 1, text), (None, text), (4, h.prose(r, vocab, 90))]
    docs = spark.createDataFrame([(*x, 1, 2, 3, 4) for x in rows], "doc_id long, text string, __t int, __doc int, __spans int, __cut int")
    found = {(x.doc_id, x.removed, x.source_doc_id) for x in sparse_suffix.reported(docs).collect()}
    assert found == {((1 << 63) - 1, False, (1 << 63) - 1), (None, True, (1 << 63) - 1)}
    out = sparse_suffix.without_repeats(docs)
    assert out.columns == docs.columns and {x.doc_id for x in out.collect()} == {(1 << 63) - 1, 4}
    one = signature_join.one_of_each(docs)
    assert one.columns == docs.columns and {x.doc_id for x in one.collect()} == {(1 << 63) - 1, 4}
    assert {(x.doc_id, x.component_id) for x in signature_join.joined(docs).collect()} == {((1 << 63) - 1, (1 << 63) - 1), (None, (1 << 63) - 1), (4, 4)}


# ---- 2: language model ----


def plain_katz(rows):
    """Katz's recursion by its definition: (tokens, base, score) of a text, and the probability of a word after two."""
    tokens = [(h.crc(i) % 5 != 1, [*h.words(t), "</s>"]) for i, t in rows]
    one, two, three = Counter(), Counter(), Counter()
    for train, w in tokens:
        if train:
            one.update(w)
            two.update(zip(["</s>", *w[:-1]], w))
            three.update(zip(["</s>", *w[:-2]], w, w[1:]))
    three = Counter({k: c for k, c in three.items() if c > 1})
    n, v = sum(one.values()), len(one)
    times = lambda x: [sum(c == r for c in x.values()) for r in range(1, 7)]
    d1, d2, d3 = katz_lm.discounts(times(one)), katz_lm.discounts(times(two)), katz_lm.cut_discounts(times(three))
    share = lambda d, c: (d[c] if c <= 5 else 1.0) * c
    p1 = lambda w: share(d1, one[w]) / n if one[w] else sum(c - share(d1, c) for c in one.values()) / n
    after: dict = {}
    for (*context, b), c in [*two.items(), *three.items()]:
        after.setdefault(tuple(context), {})[b] = c

    def backoff(context, whole, d, lower):
        left = whole - sum(share(d, c) for c in after[context].values())
        factor, left = (1.0, left / whole) if left > 1e-9 else (whole / (whole + 1), 1 / (whole + 1))
        return factor, left / (1 - sum(lower(b) for b in after[context]))

    def p2(a, b):
        if not one[a]:
            return p1(b)
        factor, alpha = backoff((a,), one[a], d2, p1)
        return factor * share(d2, two[a, b]) / one[a] if two[a, b] else alpha * p1(b)

    def p3(a, b, c):
        if (a, b) not in after:
            return p2(b, c)
        factor, alpha = backoff((a, b), two[a, b], d3, lambda x: p2(b, x))
        return factor * share(d3, three[a, b, c]) / two[a, b] if three[a, b, c] else alpha * p2(b, c)

    def text(w):
        w = [*w, "</s>"]
        score = math.log10(p2("</s>", w[0])) + sum(math.log10(p3(*x)) for x in zip(["</s>", *w[:-2]], w, w[1:]))
        return len(w), sum(one[b] > 0 for b in w), n, sum(math.log10((one[b] + 0.5) / (n + 0.5 * (v + 1))) for b in w), score

    return text, p3, one, after


def test_katz_scores(docs, rows, empty):
    got = {}
    for r in katz_lm.scored(docs).collect():
        got.setdefault((r.doc_id, r.n_tokens), []).append(r)
    text, p3, one, after = plain_katz(rows)
    contexts = [x for x in after if len(x) == 2]
    assert len(contexts) > 20
    for i, t in rows:
        size, known, n, base, score = text(h.words(t))
        hits = [r for r in got[i, size] if math.isclose(r.score, score, rel_tol=1e-9, abs_tol=1e-9)]
        assert hits and all((r.held_out, r.n_known, r.train_tokens) == (h.crc(i) % 5 == 1, known, n) and math.isclose(r.base_score, base, rel_tol=1e-9) for r in hits)
    # exactly normalised: the whole vocabulary and the unknown word after two words
    for a, b in contexts[:10]:
        assert math.isclose(sum(p3(a, b, c) for c in [*one, "never"]), 1.0, rel_tol=1e-9)
    assert katz_lm.scored(empty).count() == 0


def test_katz_answers_are_small(spark, tmp_path):
    """What a count's place or the use of a context tells is not sent: counts that fall with the words' numbers, alpha's sums where nothing backs off."""
    path = str(tmp_path / "model")
    katz_lm.scored(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), model_path=path).count()
    size = {t: spark.read.schema(katz_lm.ANSWERS).parquet(f"{path}/{t}").where("kind = 'answer'").select(F.sum(sum(F.coalesce(F.octet_length(c), F.lit(0)) for c in "abc"))).first()[0] for t in ("unigrams", "bigrams", "trigrams")}
    assert size["unigrams"] < 185_000 and size["bigrams"] < 150_000 and size["trigrams"] < 50_000, size


def test_katz_words_numbers_in_fewer_bytes():
    rng = np.random.default_rng(3)
    of = rng.integers(0, 1 << 40, 300)
    w = rng.integers(0, 300, 1000)
    assert (katz_lm.from_by_word(katz_lm.by_word(w, of[w]), w) == of[w]).all() and not len(katz_lm.from_by_word(katz_lm.by_word(w[:0], w[:0]), w[:0]))
    number, count = rng.permutation(500), np.sort(rng.integers(0, 50, 500))[::-1]
    assert (katz_lm.from_falling(katz_lm.falling(number, count[number]), number) == count[number]).all()


def test_katz_answers_leave_out_what_a_batch_can_tell(spark, tmp_path):
    """Words of one count are numbered by hash, so that counts tell their order; a batch with all kept trigrams of a context tells its sums."""
    path = str(tmp_path / "model")
    katz_lm.scored(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), model_path=path).count()
    size = {t: spark.read.schema(katz_lm.ANSWERS).parquet(f"{path}/{t}").where("kind = 'answer'").select(F.sum(sum(F.coalesce(F.octet_length(c), F.lit(0)) for c in "abcd"))).first()[0] for t in ("unigrams", "trigrams")}
    assert size["unigrams"] < 60_000 and size["trigrams"] < 20_000, size


def test_katz_own_counts_of_rare_words_only():
    rng = np.random.default_rng(5)
    of, w = rng.integers(0, 1 << 40, 300), rng.integers(0, 300, 1000)
    for n_top in (1, 100, 300):
        assert (katz_lm.from_rare_counts(katz_lm.rare_counts(w, of[w], n_top), w, of[:n_top]) == of[w]).all()
    assert len(katz_lm.rare_counts(w, of[w], 300)) < 20


def test_katz_leaves_only_what_the_scores_need(spark, docs, rows):
    """Without a path for the model, answers and batches go once they are used."""
    out = katz_lm.scored(docs)
    top = Path(common.WRITTEN[-1].removeprefix("file://"))
    left = {f"{x.parent.name}/{x.name}" for x in top.glob("*/kind=answer")} | {x.name for x in top.iterdir()}
    assert left == {"numbered", "pairs", "parts", "unigrams", "bigrams", "trigrams", "trigrams/kind=answer"}
    assert out.count() == len(rows)


def test_katz_by_stored_tables(spark, docs, rows, tmp_path):
    """Other texts, scored by the tables of a stored model; the catalog holds no table of it."""
    path = f"file://{tmp_path}/a.model-1"
    trained = {(r.doc_id, r.n_tokens, round(r.score, 9)) for r in katz_lm.scored(docs, model_path=path).collect()}
    assert trained == {(r.doc_id, r.n_tokens, round(r.score, 9)) for r in katz_lm.scored_by(docs, path).collect()}
    new = [(1, "something new"), (2, " ".join(h.words(rows[0][1])[i].decode() for i in range(30))), (3, None)]
    text = plain_katz(rows)[0]
    got = {r.doc_id: r for r in katz_lm.scored_by(spark.createDataFrame(new, "doc_id long, text string"), path).collect()}
    for i, t in new:
        size, known, n, base, score = text(h.words(t))
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (size, known, n) and math.isclose(got[i].score, score, rel_tol=1e-9) and math.isclose(got[i].base_score, base, rel_tol=1e-9)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("katz")]


def test_numbers_of_any_size_are_apart():
    r = np.random.default_rng(0)
    a, b = r.integers(0, 1 << 40, 50)[r.integers(0, 50, 900)], r.integers(0, 1 << 40, 50)[r.integers(0, 50, 900)]
    where, at = katz_lm.unique_rows(a, b)
    pairs = list(zip(a.tolist(), b.tolist()))
    assert [pairs[i] for i in where] == sorted(set(pairs)) and [pairs[where[k]] for k in at] == pairs


def test_held_out_text_is_likelier_than_by_the_base(spark):
    rows = katz_lm.scored(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert rows[0] > rows[1]


# ---- 3: quality classifier ----


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = mil_quality.judged(spark.read.parquet(f"{sf}/documents.parquet"), labels).join(labels, "doc_id").where("held_out and quality is not null").collect()
    assert np.mean([r.predicted == r.quality for r in out]) > 0.93 and all(0 <= r.score <= 1 for r in out)


def test_quality_of_odd_documents(spark, docs, rows, empty):
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)] + [(1, None), (None, 1), (2, 1), (2, 0)], "doc_id long, quality int")
    out = mil_quality.judged(docs, labels)
    got = out.collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == (h.crc(r.doc_id) % 5 == 0) for r in got)
    assert {(r.doc_id, r.score) for r in got} == {(r.doc_id, r.score) for r in mil_quality.judged(docs, labels).collect()}
    assert mil_quality.accepted(docs, labels).columns == docs.columns
    none = labels.where("false")
    assert {r.score for r in mil_quality.judged(docs, none).collect()} == {1.0}
    assert mil_quality.judged(empty, labels).count() == 0


def test_gradients_of_the_attention_model():
    r = np.random.default_rng(0)
    x, count, y = r.normal(size=(9, mil_quality.FEATURES)), np.array([2, 4, 3]), np.array([1.0, 0.0, 1.0])
    m = mil_quality.Model(0.6)
    m.start(x)
    loss = lambda: -np.mean(y * np.log(m.forward(x, count)["score"]) + (1 - y) * np.log(1 - m.forward(x, count)["score"]))
    for name, g in m.gradients(m.forward(x, count), count, y).items():
        at = tuple(0 for _ in np.shape(g))
        w = np.array(m.weights[name], float)
        for sign in (1, -1):
            m.weights[name] = w.copy()
            m.weights[name][at] += sign * 1e-5
            up, down = (loss(), None) if sign == 1 else (up, loss())  # noqa: F821
        m.weights[name] = w
        assert math.isclose((up - down) / 2e-5, np.asarray(g)[at], rel_tol=1e-3, abs_tol=1e-7), name


def plain_encoding(text):
    """The encodings of a text's passages, one after the other."""
    raw = (text or "").encode()
    at = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
    w = [raw[a:b] for a, b in at]
    low = [x.translate(h.LOWER) for x in w]
    n = max(1, (len(w) + mil_quality.PASSAGE // 2) // mil_quality.PASSAGE)
    lines: list[list[bytes]] = []
    for k, x in enumerate(low):
        if not k or b"\n" in raw[at[k - 1][1] : at[k][0]]:
            lines.append([])
        lines[-1].append(x)
    out = []
    for p in range(n):
        a, b = len(w) * p // n, len(w) * (p + 1) // n
        x = np.zeros(mil_quality.FEATURES)
        if b > a:
            span = raw[at[a][0] : at[b - 1][1]]
            for c in range(mil_quality.N_CLASSES):
                x[c] = math.log1p(100 * sum(mil_quality.CLASSES[y] == c for y in span) / len(span))
            size = [len(y) for y in w[a:b]]
            x[9], x[10], x[11] = np.mean(size), np.std(size), size.count(1) / (b - a)
            x[12] = len(set(low[a:b])) / (b - a)
            x[13] = len({(low[k], low[(k + 1) % len(low)]) for k in range(a, b)}) / (b - a)
            x[14] = math.log1p(b - a)
        x[15] = math.log1p(len(w))
        if w:
            x[16] = math.log(max(1e-4, len(set(low)) / len(w)))
            x[17] = 1 - len(set(map(tuple, lines))) / len(lines)
        out.append(x)
    return out


def test_encodings_are_those_of_a_plain_loop(rows):
    for _, t in rows:
        got, n = mil_quality.encoded(*common.buffers(pa.array([t], pa.string())))
        want = plain_encoding(t)
        assert n.tolist() == [len(want)] and np.allclose(got, want, atol=1e-6)


def test_scores_are_those_of_a_plain_loop():
    r = np.random.default_rng(4)
    x, count = r.normal(size=(12, mil_quality.FEATURES)), np.array([1, 7, 4])
    m = mil_quality.Model(0.5)
    m.start(x)
    k, got, at = m.weights, m.score(x, count)[0], 0
    for bag, n in enumerate(count):
        own = [(y - m.mean) / m.deviation for y in x[at : at + n]]
        at += n
        states = [np.tanh(y.clip(-8, 8) @ k["w"] + k["b"]) for y in own]
        gates = [math.exp((np.tanh(y @ k["v"] + k["vb"]) / (1 + np.exp(-(y @ k["u"] + k["ub"])))) @ k["a"]) for y in states]
        z = sum(g * y for g, y in zip(gates, states)) / sum(gates)
        assert math.isclose(got[bag], 1 / (1 + math.exp(-(z @ k["c"] + k["d"]))), rel_tol=1e-9)


def test_fit_takes_each_document_once(spark, monkeypatch):
    """A document that is repeated is one bag; the sample ends where its passages would pass the bound."""
    r, vocab = random.Random(2), h.vocabulary()
    ids = [i for i in range(60) if h.crc(i) % 5]
    docs = spark.createDataFrame([(i, h.prose(r, vocab, 100)) for i in ids] + [(ids[0], "again and again")] * 500, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, quality int")
    bags = []
    monkeypatch.setattr(mil_quality.Model, "fit", lambda self, x, y: bags.append(x))
    mil_quality.fitted(docs, labels)
    mil_quality.fitted(docs, labels, sample_passages=20)
    assert len(bags[0]) == len(ids) and 5 < sum(map(len, bags[1])) <= 20


def test_names_that_clash(spark):
    docs = spark.createDataFrame([(i, "some words here " * 20, 1.0, 2, 3) for i in range(9)], "doc_id long, text string, __mil_score double, __fm_items int, __FM_starts int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(9)], "doc_id long, quality int")
    out = mil_quality.accepted(docs, labels)
    assert out.columns == docs.columns and out.count() in (0, 9)
    out = fm_decontaminate.decontaminated(docs, spark.createDataFrame([(1, "never seen")], "item_id long, text string"))
    assert out.columns == docs.columns and out.count() == 9


def test_readme_names_the_fit_sample():
    text = (Path(__file__).parents[2] / "README.md").read_text()
    assert "`SAMPLE_ROWS`" in text and "`SAMPLE_PASSAGES`" in text


# ---- 4: quality rules ----


def test_rule_counts(docs, rows, empty):
    def repeats(w):
        win = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        n = Counter(win)
        return len({i + k for i, x in enumerate(win) if n[x] > 1 for k in range(5)})

    want = Counter()
    for i, t in rows:
        t = t or ""
        w = [x for x in re.split("[\x20\x09-\x0d]+", t) if x]
        lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        n = repeats(w)
        want[i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), n, len(w) < 10 or 100 * n > 20 * len(w)] += 1
    got = rule_filter.judged(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert all(not (r.base_failed and r.kept) and r.kept == (not r.base_failed and not r.broken_rules) for r in got)
    assert rule_filter.judged(empty).count() == 0
    plan = rule_filter.judged(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("InMemoryRelation")[0] and "Python" not in plan


# ---- 5: sharding ----


def test_shards(docs, rows, empty):
    got = tree_shard.sharded(docs, bucket_rows=10, copies=1).collect()
    assert len(got) == len(rows) and all(r.law == "key" and 0 <= r.shard < 16 and r.grown_shard in (r.shard, 16) for r in got)
    assert len({(r.doc_id, r.shard) for r in got}) == len({r.doc_id for r in got})
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert tree_shard.sharded(empty).count() == 0


def test_weights_and_growth(spark):
    many = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    tree = {0: {0: {0: 1.0, 1: 3.0}}, 1: {0: {2: 2.0}, 1: {3: 2.0}}}
    grown = {0: {0: {0: 1.0, 1: 3.0}}, 1: {0: {2: 4.0}, 1: {3: 2.0}}}
    got = tree_shard.placed(many, tree, grown).groupBy("shard", "grown_shard").count().collect()
    share = {s: sum(r["count"] for r in got if r.shard == s) / 20_000 for s in range(4)}
    assert all(abs(share[s] - w / 8) < 0.02 for s, w in ((0, 1), (1, 3), (2, 2), (3, 2)))
    assert all(r.grown_shard in (r.shard, 2) for r in got)


# ---- 6: packing ----


def test_pieces_hold_every_id_once(docs, rows, empty):
    from tokenizers import Tokenizer

    enc = Tokenizer.from_file(cost_pack.tokenizer_path())
    pieces = cost_pack.packed(docs).collect()
    want = Counter()
    for i, t in rows:
        ids = [*enc.encode(t or "", add_special_tokens=False).ids, 1]
        want[i, len(ids)] += 1
        if i is not None and sum(x == i for x, _ in rows) == 1:
            own = sorted((p for p in pieces if p.doc_id == i), key=lambda p: p.start)
            assert [p.start for p in own] == list(np.cumsum([0, *(p.length for p in own)])[:-1]) and sum(p.length for p in own) == len(ids)
            for p in own:
                assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
    assert Counter((p.doc_id, p.doc_tokens) for p in pieces if p.start == 0) == want
    for s in {p.sequence_id for p in pieces}:
        own = sorted((p for p in pieces if p.sequence_id == s), key=lambda p: p.offset)
        assert [p.offset for p in own] == list(np.cumsum([0, *(p.length for p in own)])[:-1]) and sum(p.length for p in own) <= 2048
    assert cost_pack.packed(empty).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 9000), min_size=1, max_size=60))
def test_packing_pads_less_than_a_sequence(lengths):
    out = cost_pack.pack(np.array(lengths))
    held = Counter()
    for d, start, n, s, offset in out:
        assert offset == held[s] and n > 0
        held[s] += n
    assert sum(held.values()) == sum(lengths) and max(held.values()) <= 2048 and len(held) == -(-sum(lengths) // 2048)


def test_packing_balances_cost():
    r = np.random.default_rng(0)
    out = cost_pack.pack(r.integers(20, 900, 2000))
    cost = Counter()
    for _, _, n, s, _ in out:
        cost[s] += n + n * n / 2048
    values = np.array(list(cost.values()))
    assert values.std() / values.mean() < 0.1


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_word_wise_ids_are_the_tokenisers(texts):
    t = cost_pack.tokenizer(cost_pack.tokenizer_path())
    ids, n = t.ids(*common.buffers(pa.array(texts, pa.string())))
    want = [t.encoder.encode(x, add_special_tokens=False).ids for x in texts]
    assert ids.tolist() == [y for x in want for y in x] and n.tolist() == [len(x) for x in want]


# ---- 7: n-gram Jaccard join ----


@pytest.mark.parametrize("chunk", [4096, 2])
def test_near_components(docs, rows, empty, chunk):
    root, size = h.near_components(rows)
    low = {}
    for k, (i, _) in enumerate(rows):
        low.setdefault(root[k], []).append(i)
    low = {k: min((x for x in v if x is not None), default=None) for k, v in low.items()}
    want = Counter((i, size[k], low[root[k]] if size[k] else i) for k, (i, _) in enumerate(rows))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in signature_join.joined(docs, chunk).collect()) == want
    assert signature_join.joined(empty).count() == 0


def test_one_of_each_component(docs, rows):
    root, size = h.near_components(rows)
    out = signature_join.one_of_each(docs)
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert out.columns == docs.columns and len(got) == len(set(got))
    wordless = {(i, t or "") for k, (i, t) in enumerate(rows) if not size[k]}
    assert len(got) == len({root[k] for k in range(len(rows)) if size[k]}) + len(wordless)


def test_many_near_copies_make_one_component(spark):
    r, vocab = random.Random(5), h.vocabulary()
    base = h.prose(r, vocab, 200).split()
    rows = []
    for i in range(150):
        w = list(base)
        w[r.randrange(200)] = f"own{i}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, h.prose(r, vocab, 150) + " " + " ".join(base[:60])) for i in range(40)]
    got = {x.doc_id: x.component_id for x in signature_join.joined(h.frame(spark, rows)).collect()}
    root, _ = h.near_components(rows)
    assert got == {i: min(rows[k][0] for k in range(len(rows)) if root[k] == root[j]) for j, (i, _) in enumerate(rows)}


def test_a_large_group_is_sent_twice(spark, monkeypatch):
    """Near copies in a group of many chunks: each class goes to two chunks, no pair of chunks is sent."""
    r, vocab = random.Random(6), h.vocabulary()
    base = h.prose(r, vocab, 200).split()
    rows = [(i, " ".join([*base[: i % 200], f"own{i}", *base[i % 200 :]])) for i in range(600)]
    rows += [(2000 + i, h.prose(r, vocab, 100) + f" end{i} " + " ".join(base[:30])) for i in range(30)]
    sent, keep = [], signature_join.chunked

    def counted(members, group, chunk):
        sent.append((tuple(group), members.count()))
        return keep(members, group, chunk)

    monkeypatch.setattr(signature_join, "chunked", counted)
    got = {x.doc_id: x.component_id for x in signature_join.joined(h.frame(spark, rows), 64).collect()}
    assert got == {i: 0 if i < 2000 else i for i, _ in rows}
    assert not any(len(g) > 1 and n > 2000 for g, n in sent)


# ---- 10: decontamination ----


def plain_hits(rows, items):
    w = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().translate(h.LOWER).decode())
    windows = {}
    for name, t in items:
        if name is None:
            continue
        x = w(t)
        for k in range(max(1, len(x) - 12) if x else 0):
            windows.setdefault(tuple(x[k : k + 13]), set()).add(str(name))
    sizes = {len(k) for k in windows}
    out = Counter()
    for i, t in rows:
        x, hit, names = w(t), set(), set()
        for n in sizes:
            for k in range(len(x) - n + 1):
                if found := windows.get(tuple(x[k : k + n])):
                    hit.update(range(k, k + n))
                    names |= found
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out[i, len(x), len(hit), len(names), digest, len(hit) > 0 and 20 * len(hit) >= len(x)] += 1
    return out


@pytest.mark.parametrize(("phrase_bytes", "shard_bytes"), [(1 << 20, fm_decontaminate.SHARD_BYTES), (300, 5000)])
def test_contamination(spark, docs, rows, empty, phrase_bytes, shard_bytes, monkeypatch):
    monkeypatch.setattr(fm_decontaminate, "SHARD_BYTES", shard_bytes)
    part = lambda i, a, b: " ".join((rows[i][1] or "").split()[a:b])
    items = [(1, part(0, 10, 40)), (2, part(1, 5, 12)), (3, part(0, 20, 33).upper().replace("É", "é")), (4, None), (5, ""), (6, "one, two"), (7, part(15, 3000, 3050)), (7, part(2, 0, 13)), (None, part(3, 0, 30)), (10, "never seen " * 20), (11, "same")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = fm_decontaminate.digested(*fm_decontaminate.hit_spans(docs.select("doc_id", "text"), bench, carry=["doc_id"], phrase_bytes=phrase_bytes)).collect()
    assert Counter(tuple(r) for r in got) == plain_hits(rows, items)
    clean = fm_decontaminate.decontaminated(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(not r.contaminated for r in got)
    assert fm_decontaminate.judged(empty, bench).count() == 0
    assert fm_decontaminate.judged(docs, bench.where("false")).where("n_hit > 0").count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=60), st.lists(st.lists(st.integers(1, 4), min_size=1, max_size=4), min_size=1, max_size=6))
def test_fm_index_finds_all_occurrences(text, patterns):
    text = np.array([*text, 0])
    index = fm_decontaminate.FMIndex(text, 5)
    length = np.array([len(p) for p in patterns])
    low, high = index.search(np.array([x for p in patterns for x in p]), np.cumsum(length) - length, length)
    for i, p in enumerate(patterns):
        want = [k for k in range(len(text)) if text[k : k + len(p)].tolist() == p]
        assert sorted(index.locate(np.arange(low[i], high[i])).tolist()) == want
