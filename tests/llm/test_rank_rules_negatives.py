"""Lexical search, quality rules and hard negatives against plain definitions, with odd rows."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import lexical, negatives, quality

DOC = "doc_id bigint, text string, term string, block string, n bigint, lang string, level int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
ODD = [(1, None), (2, ""), (3, " \n\t.,!"), (4, "a  b ▁c　é 日本 \U0001f600 İSTANBUL ÀB"), (5, "word " * 30_000), (6, "same text"), (6, "same text"), (None, "same text"), (7, "x" * 50_000)]


def docs(spark, rows, lang=lambda i: "en"):
    return spark.createDataFrame([(i, t, "clash", None, 1, lang(i), 2) for i, t in rows], DOC)


def items(spark, rows):
    return spark.createDataFrame([(i, t, 9, "clash") for i, t in rows], "item_id bigint, text string, doc_id int, terms string")


def by_hand(rows, asked, k):
    split = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in rows]
    split = [(i, c) for i, c in split if c]
    n_docs, total = len(split), sum(sum(c.values()) for _, c in split)
    df = Counter(t for _, c in split for t in c)
    out = []
    for item, text in asked:
        scored = []
        for i, c in split:
            m = 10 + (90 * sum(c.values()) * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(TERM.findall((text or "").translate(LOWER))) if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k], 1)]
    return out


@pytest.mark.parametrize("block", [2048, 70])
def test_lexical(spark, monkeypatch, block):
    monkeypatch.setattr(lexical, "DOCS", block)
    monkeypatch.setattr(lexical, "POSTINGS", 40 * block)
    rng = random.Random(5)
    words = [f"w{int(rng.paretovariate(0.7)) % 300}" for _ in range(5_000)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(1, 60)))) for i in range(10, 700)] + ODD
    asked = [(j, " ".join(rng.choices(words, k=12))) for j in range(40)] + [(50, "same"), (51, None), (52, "no such"), (53, "WORD word x日本 日本 istanbul àb Àb"), (54, " ".join(f"w{i}" for i in range(3_000)))]
    got = lexical.rank(docs(spark, rows), items(spark, [*asked, (None, "same")]), k=7).collect()
    assert sorted((tuple(r) for r in got), key=lambda r: r[:2]) == by_hand(rows, asked, 7)


def test_lexical_without_rows(spark):
    one = docs(spark, [(1, "a b")])
    assert lexical.rank(docs(spark, []), items(spark, [(1, "a")])).count() == 0
    assert lexical.rank(one, items(spark, [])).count() == 0
    assert lexical.rank(one, items(spark, [(1, None)])).count() == 0
    assert [tuple(r) for r in lexical.rank(docs(spark, [(1, "a a"), (2, None)]), items(spark, [(4, "A")])).collect()] == [(4, 1, 1, math.floor(1000 * math.log(4 / 3)) * (2 * 10**9 // (2000 + 800)))]


def test_carries_of_long_sums():
    """Sums of many terms reach slices above the impacts' own."""
    rng = np.random.default_rng(3)
    n, ids = 130, list(range(130))
    impact = {f"t{i:02}".encode(): {int(p): int(rng.integers(1, 1 << 35)) for p in rng.choice(n, 60, replace=False)} for i in range(40)}
    terms = sorted(impact)
    flat = [(p, impact[t][p]) for t in terms for p in sorted(impact[t])]
    width = max(v for _, v in flat).bit_length()
    slices = b"".join(np.packbits(np.array([v >> b & 1 for _, v in flat], dtype=bool), bitorder="little").tobytes() for b in range(width))
    starts = np.cumsum([0, *(len(impact[t]) for t in terms)]).astype("<i8").tobytes()
    block = lexical.Block(ids, terms, starts, np.array([p for p, _ in flat], "<u2").tobytes(), width, slices)
    asked = [terms, terms[:3], [b"none"], []]
    for found, own in zip(block.top(block.sums(asked), 9), asked, strict=True):
        want = Counter()
        for t in own:
            want.update(impact.get(t, {}))
        assert sorted(found, key=lambda x: (-x[1], x[0])) == sorted(want.items(), key=lambda x: (-x[1], x[0]))[:9]


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    inside = {i + j for i, w in enumerate(zip(words, words[1:], words[2:], strict=False)) if windows[w] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside), len(lines)


def test_text_counts():
    rng = random.Random(1)
    texts = [t for _, t in ODD] + ["".join(rng.choices(["a", "b", "é", "\n", " ", "\t", "　", "\x0b", "\x1c", "#", "|", "\U0001f600", "\r"], k=rng.randint(0, 90))) for _ in range(3_000)]
    assert [quality.text_counts(t) for t in texts] == list(map(plain_counts, texts))


def test_repeated_words_of_many_distinct(monkeypatch):
    words = [b"%d" % (i % 1_100_000) for i in range(1_100_010)]
    assert quality.repeated_words(words) == 20


def test_binomial(spark):
    for n, k, p in [(500, 2, 0.01), (2_000, 9, 0.01), (90, 0, 0.01), (4_000, 30, 0.01), (50, 3, 0.2), (10, 5, 0.1), (0, 0, 0.1)]:
        got = spark.sql(f"SELECT {n}L AS n, {k}L AS k").select(quality.at_most(_c("k"), _c("n"), p)).first()[0]
        want = 1.0 if k >= n * p else sum(math.exp(math.log(math.comb(n, i)) + i * math.log(p) + (n - i) * math.log(1 - p)) for i in range(k + 1))
        assert got == pytest.approx(want, rel=1e-8)


def _c(name):
    from pyspark.sql import functions as F

    return F.col(name)


def test_rules_hold_their_risk(spark):
    """Junk is found where labels prove a cutoff; where good documents fail it too, or labels are few, nothing is lost."""
    rng = random.Random(2)
    plain = lambda mark="": " ".join(rng.choice(["river", "stone", "garden", "winter", "letter", "music"]) + (mark + str(rng.random())[2:7])[:5] for _ in range(60))
    rows, labels, lang = [], [], {}
    for i in range(4_400):
        junk = i % 4 == 0
        lang[i] = "xx" if i >= 4_300 else "de" if i % 3 == 0 else None if i % 3 == 1 else "en"
        rows.append((i, plain("###" if junk or lang[i] == "de" else "")))  # in German, good ones have symbols too
        labels.append((i, 0 if junk else 1))
    spark_labels = spark.createDataFrame([(i, q, "x", 0.5) for i, q in [*labels, *labels[:50], (9, 0), (9, 1), (None, 1), (5, 7), (10**9, 1)]], "doc_id bigint, quality int, stratum string, level double")
    got = {r.doc_id: r for r in quality.judge(docs(spark, rows + [(i + 10_000 if i else i, t) for i, t in ODD], lambda i: lang.get(i, "en")), spark_labels).collect()}
    for i in range(4_400):
        assert got[i].failed == (["symbols"] if i % 4 == 0 and lang[i] in (None, "en") else []), (i, lang[i])
        assert got[i].kept == (not got[i].failed)
    assert not got[None].kept and got[10_001].n_words == 0 and got[10_005].base_failed
    measured = quality.measure(docs(spark, rows, lambda i: lang[i]))
    held = {(r.stratum, r.rule): r for r in quality.thresholds(measured, spark_labels).collect()}
    good = {s: sum(q and lang[i] == s and _fold(i) and i != 9 for i, q in labels) for s in ("en", None)}
    assert {k: (v.good, v.lost) for k, v in held.items()} == {('["en"]', "symbols"): (good["en"], 0), ("[null]", "symbols"): (good[None], 0)}
    # a looser risk proves no less, none at all proves nothing
    assert quality.thresholds(measured, spark_labels, risk=1e-4).count() == 0
    assert quality.judge(docs(spark, []), spark_labels).count() == 0
    assert {r.kept for r in quality.judge(docs(spark, rows[:20]), spark_labels.limit(0)).collect()} == {True}


def _fold(i):
    import zlib

    return zlib.crc32(str(i).encode()) % quality.TUNING_OF != 0


EMB = "vec_id bigint, embedding array<float>, label int, own bigint, score int, windows string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v and [x if x is None else float(x) for x in v], y, 1, 2, "clash") for i, v, y in rows], EMB)


def mined(rows, positives=5, count=5):
    kept = {}
    for i, v, y in rows:
        if i is None or v is None or y is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        r = (y, [math.floor(256 * float(np.float32(x))) for x in v])
        kept[i] = min(kept.get(i, r), r)
    at = {i: ((y + 1) % 10 if i % 7 == 0 else y, v) for i, (y, v) in kept.items()}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for a, (y, v) in at.items():
        if a % 100 == 0:
            near = sorted((-dot(v, w), i) for i, (z, w) in at.items() if i != a and z == y)[:positives]
            other = sorted((-dot(v, w), i) for i, (z, w) in at.items() if z != y)
            for s, p in near:
                fits = [(-t, i) for t, i in other if 80 * -s <= 100 * -t <= 100 * -s][:count]
                out += [(a, p, r, i, -s, t) for r, (t, i) in enumerate(fits, 1)]
    return sorted(out)


@pytest.mark.parametrize("shard", [4096, 300])
def test_negatives(spark, monkeypatch, shard):
    monkeypatch.setattr(negatives, "SHARD", shard)
    monkeypatch.setattr(negatives, "LEAF", 16)
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(10, 6))
    rows = [(i, (centre[i % 10] + rng.normal(size=6)).tolist(), int(i * 7 % 10)) for i in range(900)]
    rows += [(i, [1.0, 0.5, 0, 0, 0, 0], i % 3) for i in range(900, 1_500)]  # one vector, three labels, many ties
    rows += [(2_000, None, 1), (2_100, [1.0, None, 0, 0, 0, 0], 1), (2_200, [1.0, float("nan")] + [0.0] * 4, 1), (2_300, [float("inf")] * 6, 2), (2_400, [0.5] * 6, None), (None, [0.5] * 6, 1)]
    rows += [(2_500, [0.0] * 6, 3), (2_600, [], 3), (2_700, [0.7, 0.2], 4), (2_701, [0.7, 0.2], 4), (3_000, [-1.0] * 6, 99), (100, rows[100][1], rows[100][2]), (200, [9.0] * 6, 9), (2_800, [100.0] * 6, 5), (2_801, [100.0] * 6, 5), (2_802, [100.0] * 6, 6)]
    got = negatives.mine(vectors(spark, rows)).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()
    assert sorted(map(tuple, got)) == mined(rows)


def test_negatives_without_rows(spark):
    assert negatives.mine(vectors(spark, [])).count() == 0
    assert negatives.mine(vectors(spark, [(1, [1.0], 1), (2, [1.0], 2)])).count() == 0  # no anchor
    assert negatives.mine(vectors(spark, [(100, [1.0], 1), (2, [1.0], 2)])).count() == 0  # no positive


def test_negatives_beyond_doubles(spark):
    """Sums that doubles can't hold are taken in whole numbers, held at a long's ends."""
    rows = [(100, [3.0e38, 1.0], 1), (3, [3.0e38, 1.0], 1), (4, [2.9e38, 0.0], 2), (200, [2.0e6, 1.0, 3.0], 3), (5, [2.0e6, 1.0, 2.0], 3), (6, [2.0e6, 1.0, 1.0], 4), (8, [1.9e6, 7.0, 1.0], 4)]
    got = sorted((r.anchor_id, r.positive_id, r.negative_id) for r in negatives.mine(vectors(spark, rows)).collect())
    top = (1 << 63) - 1
    dot = lambda a, b: max(min(sum(math.floor(256 * float(np.float32(x))) * math.floor(256 * float(np.float32(y))) for x, y in zip(a, b, strict=False)), top), -top)
    at = {i: ((y + 1) % 10 if i % 7 == 0 else y, v) for i, v, y in rows}
    want = []
    for a in (100, 200):
        for p in [i for i in at if i != a and at[i][0] == at[a][0]]:
            s = dot(at[a][1], at[p][1])
            want += [(a, p, i) for i in at if at[i][0] != at[a][0] and 80 * s <= 100 * dot(at[a][1], at[i][1]) <= 100 * s]
    assert got == sorted(want)
