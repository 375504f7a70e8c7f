"""op11 to op13 against plain versions, on small tables that hold the odd cases."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from assertlake.llm import filter_audit, prefix_trie, projection_forest
from tests.conftest import normal, same_rows

SPACE = re.compile(r"[^\x20\x09-\x0D]+")

# ---- op11


def plain_audit(docs, labels):
    """docs (doc_id, text, lang), labels (doc_id, quality, toxic): each order applied to each document."""
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    good, toxic = ({i for i, *v in labels if i is not None and v[k] == 1} for k in (0, 1))
    fails = []
    for i, t, _ in docs:
        t = t or ""
        w = SPACE.findall(t)
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(set(t) & set("#$%&*|")), "E": i is not None and i > least.get(t, i)}
        fails.append({k for k, v in f.items() if v})
    out = {}
    for part in {lang or "" for *_, lang in docs}:
        mine = [(d[0], f) for d, f in zip(docs, fails, strict=True) if (d[2] or "") == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            for k, own in enumerate(order):
                reach = [(i, f) for i, f in mine if not f & set(order[:k])]
                gone = [(i, f) for i, f in reach if own in f]
                out[part, order, k + 1] = [
                    len(reach) - len(gone), len(gone), sum(own in f and bool(f & set(order[:k])) for _, f in mine), sum(f == {own} for _, f in mine), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone),
                ]
    total = {}
    for (part, order, step), v in out.items():
        total[part, order[step - 1]] = total.get((part, order[step - 1]), 0) + v[1]
    return {key: (*v, total[key[0], key[1][key[2] - 1]]) for key, v in out.items()}


def audit_rows():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 6)))
    rows = []
    for i in range(60):
        text = " ".join(word() for _ in range(r.choice([3, 150, 260, 300])))
        text = r.choice([text, text.upper(), text + " #", " \n\t " + text, "the the " * 120 + text])
        rows.append((i, text, r.choice(["en", "de", None])))
    rows += [(100 + k, rows[k % 7][1], r.choice(["en", "fr"])) for k in range(30)]  # copies
    rows += [rows[3], rows[3], (None, rows[3][1], "en"), (None, None, None), (None, "", ""), (7, None, "en"), (8, "", "en"), (9, "x " * 50_000, "en"), (5, rows[4][1], "en"), (1 << 62, rows[2][1], "en")]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(0, 120, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (10_000, 1, 1)]
    return rows, labels


def test_audit_against_each_order(spark):
    rows, labels = audit_rows()
    docs = spark.createDataFrame([(*x, "clash", 1, 2) for x in rows], "doc_id long, text string, lang string, part string, mask int, n int")
    marks = spark.createDataFrame([(*x, "clash") for x in labels], "doc_id long, quality int, toxic int, good string")
    got = {(r.part, r.filter_order, r.step): tuple(r[c] for c in filter_audit.COUNTS) for r in filter_audit.audited(docs.repartition(3), marks).collect()}
    assert got == plain_audit(rows, labels)


def test_audit_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audited(empty, marks).count() == 0
    one = spark.createDataFrame([(None, None, None)], "doc_id long, text string, lang string")
    got = filter_audit.audited(one, marks).collect()
    assert len(got) == 600 and {r.part for r in got} == {""} and all(r.good_lost == r.toxic_lost == 0 for r in got)
    assert {(r.kept, r.removed) for r in got if r.filter_order[r.step - 1] == "A"} == {(0, 1)}  # no words are under 200


# ---- op12


def plain_trie(rows):
    """rows (conv_id, turn, role, text) -> the nodes, by the whole prefixes."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own.setdefault(c, []).append((turn is not None, turn or 0, digest, role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    paths = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        paths[c] = own.get(base, [])[:h] + mine[h:]
    nodes = {}
    for c in sorted(paths):
        for d in range(len(paths[c]) + 1):
            nodes.setdefault(tuple(paths[c][:d]), []).append(c)
    kids = {}
    for prefix in nodes:
        if prefix:
            kids.setdefault(prefix[:-1], []).append(prefix)
    leaves, tokens, out = {}, {}, []
    for prefix in sorted(nodes, key=len, reverse=True):
        below = kids.get(prefix, [])
        leaves[prefix] = sum(leaves[k] for k in below) or 1
        tokens[prefix] = sum(tokens[k] for k in below) + (len(nodes[prefix]) - 1) * (len(prefix[-1][1].encode()) if prefix else 0)
        ends = ",".join(str(c) for c in nodes[prefix] if len(paths[c]) == len(prefix))
        up = nodes[prefix[:-1]][0] if prefix else None
        out.append((nodes[prefix][0], len(prefix), up, len(nodes[prefix]), len(below), leaves[prefix], tokens[prefix], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


TURNS = "conv_id long, turn long, role string, text string, depth int, f string, members int"


def trie_of(spark, rows, spread=5):
    df = spark.createDataFrame([(*x, 1, "clash", 2) for x in rows], TURNS).repartition(spread)
    return sorted((tuple(r) for r in prefix_trie.trie(df).collect()), key=lambda r: r[:2])


def talk_rows():
    r = random.Random(3)
    text = lambda: "".join(r.choice("abcé ") for _ in range(r.randint(0, 12)))
    shared = [text() for _ in range(4)]
    rows = [(c, t, r.choice(["user", "assistant", None]) if r.random() < 0.1 else "user", r.choice(shared) if r.random() < 0.7 else text()) for c in range(-12, 60) for t in range(r.randint(1, 12))]
    rows += [(c, t, "user", "same beginning") for c in (70, 71, 72, 73, 74, 80, 85) for t in range(10)]  # whole copies
    rows += [(91, t, "user", f"no base {t}") for t in range(3)] + [(96, 0, "user", "gone where its first turns are a base's that isn't there")]
    rows += [(3, None, None, None), (3, None, "user", ""), (3, 1, "user", "tie"), (3, 1, "user", "tie"), (3, 1, "a", "tie"), (None, 1, "user", "no conversation"), (None, None, None, None)]
    rows += [((1 << 63) - 1, 0, "user", "the greatest id")]
    return rows


def test_trie_against_whole_prefixes(spark):
    rows = talk_rows()
    assert trie_of(spark, rows) == plain_trie(rows)


@pytest.mark.parametrize("copies", [1, 3])
def test_trie_of_long_conversations(spark, copies):
    """A conversation of most of the rows lies in several ranges and is longer than a family's trie; copies of it share all its nodes."""
    r = random.Random(7)
    long = [r.choice(["yes", "no", "perhaps " * 5]) for _ in range(700)]
    rows = [(20 + 5 * k, t, "user", x) for k in range(copies) for t, x in enumerate(long)]
    rows += [(c, t, "user", long[t]) for c in (21, 22, 23, 27) for t in range(90 + c)]
    rows += [(22, 300, "user", "the same, but for the end"), (10, 0, "user", "short"), (11, 0, "user", "short"), (36, 0, "user", "alone")]
    rows += [(36, t, "user", long[t]) for t in range(1, 200)]  # its base is missing
    assert trie_of(spark, rows) == plain_trie(rows)


def test_trie_of_nothing(spark):
    assert trie_of(spark, []) == [] and trie_of(spark, [(None, 1, "user", "x")]) == []
    assert trie_of(spark, [(5, None, None, None)]) == plain_trie([(5, None, None, None)])


# ---- op13


def plain_links(rows, least=0.95):
    """(vec_id, n_links, component_id, kept) of rows (vec_id, embedding), by all pairs."""
    unit = []
    for i, v in rows:
        ok = i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)
        x = np.array(v, float) if ok else None
        unit.append(x / np.abs(x).max() / np.sqrt(((x / np.abs(x).max()) ** 2).sum()) if ok else None)
    near = [[j for j, b in enumerate(unit) if j != k and a is not None and b is not None and len(a) == len(b) and a @ b >= least] for k, a in enumerate(unit)]
    reach = {i: i for i, _ in rows if i is not None}
    changed = True
    while changed:
        changed = False
        for k, js in enumerate(near):
            for j in js:
                low = min(reach[rows[k][0]], reach[rows[j][0]])
                for i in (rows[k][0], rows[j][0]):
                    changed |= reach[i] != low
                    reach[i] = low
    return sorted(([i, len(near[k]), reach.get(i), i == reach.get(i)] for k, (i, _) in enumerate(rows)), key=str)


def vectors(n=400, dim=24, seed=2):
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, dim))
    for k in range(40):  # pairs about the least cosine
        a = r.standard_normal(dim)
        a -= a @ x[k] / (x[k] @ x[k]) * x[k]
        a *= np.linalg.norm(x[k]) / np.linalg.norm(a)
        c = r.uniform(0.93, 0.97)
        x[100 + k] = (c * x[k] + np.sqrt(1 - c * c) * a) * r.uniform(0.1, 10)
    return x


def links_of(spark, rows, kind="double"):
    df = spark.createDataFrame([(i, v, 1, 2, "clash") for i, v in rows], f"vec_id long, embedding array<{kind}>, label int, key int, ball string")
    return sorted(([r.vec_id, r.n_links, r.component_id, r.kept] for r in projection_forest.deduplicated(df).collect()), key=str)


def test_forest_with_odd_vectors(spark):
    rows = [(k, list(map(float, v))) for k, v in enumerate(vectors())]
    rows += [(1000 + k, rows[7][1]) for k in range(5)] + [rows[8], rows[8]]  # copies, repeated rows
    rows += [(2000, None), (2001, []), (2002, [0.0] * 24), (2003, [1.0] * 23 + [None]), (2004, [1.0] * 23 + [float("nan")]), (2005, [float("inf")] * 24), (None, rows[7][1]), (None, None)]
    rows += [(2006, [x * 1e-300 for x in rows[9][1]]), (2007, [x * 1e300 for x in rows[9][1]]), (2008, rows[9][1][:23]), (2009, [-x for x in rows[9][1]]), (-5, rows[10][1])]
    rows += [(2010, [0.0, 1.0]), (2011, [-0.0, 1.0]), (3, rows[20][1])]  # an id with two vectors
    assert links_of(spark, rows) == plain_links(rows)


def test_forest_of_nothing(spark):
    assert links_of(spark, []) == [] and links_of(spark, [(1, None)]) == [[1, 0, 1, True]]


def test_forest_recall_and_crowds(spark):
    """12,000 vectors in leaves of at most 1500, so that the trees split: a crowd that makes a ball, one too wide for it, many small groups; most links lie near
    the least cosine. No link is wrong; at least nine of ten are found (here all but a few)."""
    r = np.random.default_rng(4)
    dim = 32
    centre = lambda n: (lambda c: c / np.linalg.norm(c, axis=1)[:, None])(r.standard_normal((n, dim)))
    around = lambda c, wide: c + wide * r.standard_normal(c.shape) / np.sqrt(dim)
    x = np.concatenate([centre(5000), around(np.repeat(centre(1), 3000, 0), 0.05), around(np.repeat(centre(1), 1000, 0), 0.22), around(np.repeat(centre(1000), 3, 0), 0.2)]).astype(np.float32)
    x = x[r.permutation(len(x))]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {q.vec_id: q for q in projection_forest.deduplicated(df).collect()}
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    want = (u @ u.T >= 0.95).sum(1) - 1
    n = np.array([got[k].n_links for k in range(len(x))])
    assert len(got) == len(x) and (n <= want).all()
    assert n.sum() >= 0.99 * want.sum()
    small = want < 100
    assert n[small].sum() >= 0.97 * want[small].sum() > 1000
    assert all(got[k].component_id <= k and got[k].kept == (got[k].component_id == k) for k in got)


def test_leaves_of_several_cells():
    """Stretches of a leaf, compared cell by cell, give the links of the leaf compared at once."""
    import pyarrow as pa

    x = vectors(300, 16, 9)
    x[:60] = x[0] + 0.1 * np.random.default_rng(1).standard_normal((60, 16))
    n = len(x)

    def cell(rows, stretch, i, j):
        cols = {"id": rows, "key": rows, "key2": rows, "w": [1] * len(rows), "x": [x[k].tobytes() for k in rows], "dim": [16] * len(rows), "ball": [-1] * len(rows), "done": [[5, 9]] * len(rows)}
        t = pa.table(cols | {"leaf": [5] * len(rows), "stretch": [stretch[k] for k in rows], "i": [i] * len(rows), "j": [j] * len(rows)})
        return projection_forest.linked(t.set_column(5, "dim", t.column("dim").cast(pa.int32())), 0.95).to_pylist()

    whole = {r["id"]: r["n"] for r in cell(list(range(n)), [0] * n, 0, 0)}
    stretch, sums = [k % 3 for k in range(n)], {}
    for i in range(3):
        for j in range(i, 3):
            for r in cell([k for k in range(n) if stretch[k] in (i, j)], stretch, i, j):
                sums[r["id"]] = sums.get(r["id"], 0) + r["n"]
    assert {k: v for k, v in sums.items() if v} == {k: v for k, v in whole.items() if v} and sum(whole.values()) > 1000
    u = x / np.linalg.norm(x, axis=1)[:, None]
    assert [whole.get(k, 0) for k in range(n)] == ((u @ u.T >= 0.95).sum(1) - 1).tolist()


def write(spark, path, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{name}")
    part = next(path.joinpath(name).glob("*.parquet"))
    part.rename(path / f"{name}.parquet")
    for x in path.joinpath(name).iterdir():
        x.unlink()
    path.joinpath(name).rmdir()


def test_same_as_sql_on_odd_rows(spark, tmp_path):
    """The SQL that the driver runs says the same as the plain versions, so as the operators, on odd rows too."""
    docs, labels = audit_rows()
    write(spark, tmp_path, "documents", docs, "doc_id long, text string, lang string")
    write(spark, tmp_path, "labels", labels, "doc_id long, quality int, toxic int")
    write(spark, tmp_path, "conversations", talk_rows(), "conv_id long, turn long, role string, text string")
    rows = [(k, list(map(float, v))) for k, v in enumerate(vectors(150))]
    write(spark, tmp_path, "embeddings", [*rows, (500, rows[3][1]), rows[4], (501, None), (502, [0.0] * 24), (None, rows[3][1])], "vec_id long, embedding array<float>")
    table = lambda name: spark.read.parquet(f"{tmp_path}/{name}.parquet")
    same_rows(spark, str(tmp_path), lambda *_: filter_audit.audited(table("documents"), table("labels")), filter_audit.oracle())
    same_rows(spark, str(tmp_path), lambda *_: prefix_trie.trie(table("conversations")), prefix_trie.oracle())
    same_rows(spark, str(tmp_path), lambda *_: projection_forest.deduplicated(table("embeddings")), projection_forest.oracle())
    assert normal(None) == "NULL"
