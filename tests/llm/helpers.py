"""Small documents that hold the odd cases, and plain versions of what the operators compute."""

import random
import zlib

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, shard int, task string, t int"


def words(text):
    return (text or "").encode().translate(LOWER).split()


def vocabulary(n=400, seed=0):
    r = random.Random(seed)
    return ["".join(r.choice(["ba", "ko", "ti", "lu", "é", "Zu", "re"]) for _ in range(r.randint(1, 4))) + str(i % 7) for i in range(n)]


def prose(r, vocab, n):
    return " ".join(r.choice(vocab) for _ in range(n))


def documents(seed=1, n=60):
    """(doc_id, text): copies, near copies, shared passages, benchmark text, repeated rows, null, empty, short and very long texts."""
    r, vocab = random.Random(seed), vocabulary()
    texts = [prose(r, vocab, r.randint(60, 300)) for _ in range(n)]
    texts[5] = texts[3]
    w = texts[4].split()
    w[20] = "changed"
    texts[6] = " ".join(w)
    w[40] = "twice"
    texts[7] = " ".join(w)
    passage = prose(r, vocab, 70)
    texts[8] += "\n" + passage
    texts[9] = passage + " " + texts[9]
    texts[10] = "\t" + passage.upper().replace("É", "é") + "\n\n" + texts[10]
    texts[11] = "one two"
    texts[12] = ""
    texts[13] = None
    texts[14] = " \n\t "
    texts[15] = prose(r, vocab, 6000)
    texts[16] = "one two"
    texts[17] = "same " * 400
    texts[18] = "x" * 20000
    texts[19] = "naïve 日本語 %%% *** ok! " * 30
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [rows[20], rows[20], (None, texts[21]), (None, "no id here " + prose(r, vocab, 80)), (22, prose(r, vocab, 90)), (None, None)]
    return rows


def frame(spark, rows):
    full = [(i, t, "en", "s", len(t) if t is not None else None, "clash", 3, "x", 1) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)


def crc(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode())


def shingles(text):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def near_components(rows):
    """The smallest id and text of the component of each row, by all pairs."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                up[find(i)] = find(j)
    return [find(i) for i in range(len(rows))], [len(s) for s in sets]


def removed_words(rows, least=50):
    """(id, text) -> places of words within a window that a text before holds; texts in the order of id, null last."""
    order = sorted({(i, t or "") for i, t in rows}, key=lambda x: (x[0] is None, x[0] or 0))
    first, out = {}, {}
    for own in order:
        w = words(own[1])
        for k in range(len(w) - least + 1):
            holder = first.setdefault(tuple(w[k : k + least]), own)
            if holder != own:
                out.setdefault(own, set()).update(range(k, k + least))
    return out
