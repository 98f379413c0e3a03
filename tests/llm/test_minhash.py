"""Near duplicates against all pairs."""

import random
import re

from tidemark.llm import minhash

SCHEMA = "doc_id bigint, text string, source string, component_id string"


def brute(rows):
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        s = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        sets[d] = s
    ids = sorted(sets)
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {d: (len(sets[d]), find(d), find(d) == d) for d in ids}


def families(seed=3):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    words = lambda n: [r.choice(vocabulary) for _ in range(n)]
    docs = []
    for _ in range(12):  # copies with edits: similarities on both sides of the threshold
        base = words(r.choice([8, 30, 90, 200]))
        for _ in range(r.choice([2, 5, 30])):
            w = list(base)
            for _ in range(int(len(w) * r.choice([0, 0.01, 0.02, 0.05, 0.1]))):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            docs.append(w)
    shared = words(70)
    docs += [shared + words(r.choice([5, 20, 40, 60])) for _ in range(60)]  # a passage of many documents
    docs += [words(r.randrange(1, 60)) for _ in range(40)]
    docs += [list("abcd"), list("ABCD"), list("abcde"), ["x"], ["x"], ["solo"]]
    r.shuffle(docs)
    return [(i * 3 + 1, r.choice([" ", "\n", " \t"]).join(w)) for i, w in enumerate(docs)]


def test_all_pairs(spark, monkeypatch):
    rows = families()
    monkeypatch.setattr(minhash, "BLOCK", 8)  # many blocks
    df = spark.createDataFrame([(d, t, "s", "clash") for d, t in rows], SCHEMA)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect()}
    assert got == brute(rows)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "ONE two"), (None, "one two"), (7, " x"), (7, " x"), (8, " ".join(map(str, range(20000)))), (9, " ".join(map(str, range(20000))) + " z")]
    out = minhash.near_duplicates(spark.createDataFrame([(d, t, "s", "c") for d, t in rows], SCHEMA)).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    assert [by[i].n_shingles for i in (1, 2, 3, 4, 7)] == [0, 0, 0, 1, 1]
    assert [by[i].component_id for i in (1, 2, 3, 4, 5, 7, 8, 9)] == [1, 2, 3, 4, 4, 7, 8, 8]
    assert by[None].component_id is None and by[None].kept and not by[9].kept
    assert minhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    kept = minhash.drop_near_duplicates(spark.createDataFrame([(d, t, "s", "c") for d, t in rows], SCHEMA))
    assert kept.columns == ["doc_id", "text", "source", "component_id"] and kept.count() == len(rows) - 2


def test_forest_of_blocks():
    import numpy as np

    ids = np.arange(6)
    sets = [np.arange(100, dtype="<i4") + s for s in (0, 1, 2, 500, 501, 900)]
    links = minhash._block_links((ids, ids.copy(), sets), None, 48, 19)
    assert len(links) == 3 and {frozenset(p) for p in links} <= {frozenset(p) for p in [(0, 1), (0, 2), (1, 2), (3, 4)]}


def test_no_link_is_lost_at_the_threshold():
    """Pairs of sets whose Jaccard similarity is 0.75 to the letter: how many retained values they share, at worst."""
    import numpy as np

    g = np.random.default_rng(8)
    for m, pairs in ((9, 4000), (40, 4000), (300, 1500), (2000, 300)):
        least = minhash.SKETCH
        for _ in range(pairs):
            v = g.permutation(np.arange(8 * m))  # ranks of hashes: 6 m common ones, m of each alone
            a, b = np.sort(v[: 7 * m])[: minhash.SKETCH], np.sort(np.concatenate([v[: 6 * m], v[7 * m :]]))[: minhash.SKETCH]
            least = min(least, len(np.intersect1d(a, b, assume_unique=True)))
        assert least >= minhash.MIN_OVERLAP, (m, least)
