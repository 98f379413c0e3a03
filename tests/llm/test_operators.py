"""The operators against brute force, exact round trips and held-out accuracy."""

from __future__ import annotations

import base64
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidemark.llm import ann, components, packing, pieces, pii, queries, token_shards, topk, toxicity, urls, warc
from tidemark.llm.common import Scratch

DOC = "doc_id bigint, text string, kind string, score double"
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "a  b ▁c　é 日本 \U0001f600 <|endoftext|> </s>"), (5, "word " * 30_000), (6, "same"), (6, "same"), (None, "no id"), (7, "x" * 50_000)]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 1.0) for i, t in rows], DOC)


def text_rows(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def rows(spark, sf):
    return text_rows(spark, sf) + [((i or 0) + 10_000_000, t) for i, t in ODD]


def test_pieces(spark, rows):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = sorted(map(tuple, pieces.encode_decode(docs(spark, rows), public_tokenizers.path("piece_bpe_32k.model")).collect()))
    want = []
    for d, t in rows:
        ids = sp.encode(t or "", add_eos=True)
        want.append((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    assert got == sorted(want)
    assert pieces.encode_decode(docs(spark, []), public_tokenizers.path("piece_bpe_32k.model")).count() == 0


def test_pieces_of_many_blocks(spark, monkeypatch):
    import sentencepiece

    monkeypatch.setattr(pieces, "PER_BUCKET", 3)
    monkeypatch.setattr(pieces, "BLOCK_BYTES", 300)
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    g = random.Random(5)
    signs = [" ", "  ", "\u2581", "a", "the", "ing", "\n", "\t", "\x00", "\u4e2d", "\U0001f600", "\u0301", "\ufffd", "1", "<0x41>", "<s>", "\u00a0"]
    texts = ["".join(g.choice(signs) for _ in range(g.randrange(0, 40))) for _ in range(300)] + [None, "", " ", "   ", "\u2581\u2581", "x" * 50_000, "the " * 5_000, "the"] + ["the"] * 200
    rows = [(None if i % 50 == 7 else i, t) for i, t in enumerate(texts)]
    got = pieces.encode_decode(docs(spark, rows), public_tokenizers.path("piece_bpe_32k.model"), ids=True).collect()
    want = sorted(((d, sp.encode(t or "", add_eos=True), sp.decode(sp.encode(t or "", add_eos=True))) for d, t in rows), key=str)
    assert sorted(((r.doc_id, r.ids, r.decoded) for r in got), key=str) == want
    assert all(r.n_tokens == len(r.ids) and r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest() for r in got)


def _ids(t):
    from tokenizers import Tokenizer

    tok = _ids.__dict__.setdefault("tok", Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))
    return tok.encode(t or "", add_special_tokens=False).ids


def test_packing(spark, rows):
    rows = [*rows, (None, "an id is missing"), (5_000_000, "a <|endoftext|> b")]
    packed = packing.pack(docs(spark, rows), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    got = packing.with_crc(packed).collect()
    assert all(len(r.ids) == r.length for r in packed.collect())
    assert sorted(r.sequence_id for r in got) == list(range(len(got))) and all(r.offset == 0 and r.length & (r.length - 1) == 0 and r.length <= 2048 for r in got)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    seen = {}
    for d, t in rows:
        if d in seen:
            continue  # the repeated row
        seen[d] = True
        ids = np.array([*_ids(t), 1], dtype="<u4")
        held = sorted({(r.start, r.length, r.ids_crc32, r.doc_tokens) for r in by[d]})  # once, where a row is repeated
        assert sum(x[1] for x in held) == len(ids) == held[0][3]
        assert all(zlib.crc32(ids[s : s + n].tobytes()) == c for s, n, c, _ in held)
    assert packing.pack(docs(spark, []), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_token_shards(spark, rows, tmp_path):
    every = [*rows, (None, "an id is missing"), (-1, "minus one"), (None, None)]
    d = docs(spark, every).repartition(16)
    path = str(tmp_path / "shards")
    files = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    out = token_shards.training_order(d, *files, path=path, length=64, per_shard=50)
    slots = out.collect()
    assert sorted(r.slot for r in slots) == list(range(len(slots)))
    read = list(token_shards.read_slots(path))
    assert [s for s, *_ in read] == list(range(len(slots))) and all(len(x[3]) == 64 for x in read[:5])
    assert [x[:3] for x in token_shards.read_slots(path, 70, 75)] == [x[:3] for x in read[70:75]]
    # documents in the order of a group, from the sequences in the order of their numbers
    by_slot = {s: ids.tolist() for s, _, _, ids in read}
    number = {r.slot: r.id for r in spark.range(len(read)).select("id", token_shards.permuted(F.col("id"), len(read), 1).alias("slot")).collect()}
    stream = [i for s in sorted(by_slot, key=number.get) for i in by_slot[s]]
    ids_of = lambda t: [*_ids(t), 50256]
    want = sorted(every, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    assert stream == [i for _, t in want for i in ids_of(t)]
    carried = {}
    for r in slots:
        for i in r.doc_ids:
            carried[i] = carried.get(i, 0) + 1
        assert r.doc_id == r.doc_ids[0]
    assert set(carried) == {i for i, _ in every} and None in carried and -1 in carried
    again = str(tmp_path / "again")
    token_shards.materialise(d.coalesce(1), again, *files, length=64, per_shard=50)
    for i in range(-(-len(read) // 50)):  # the same shards, however the input is split
        assert (tmp_path / "shards" / token_shards.shard_name(i)).read_bytes() == (tmp_path / "again" / token_shards.shard_name(i)).read_bytes()
    for n in (1, 2, 5, 1000):
        got = [r[0] for r in spark.range(n).select(token_shards.permuted(F.col("id"), n, 9)).collect()]
        assert sorted(got) == list(range(n))
    assert token_shards.training_order(docs(spark, []), files[0], path=str(tmp_path / "none")).count() == 0


def test_long_cycles(spark, monkeypatch):
    """Numbers whose cycle stays outside of the range for hundreds of steps get their slot all the same."""
    calls, size = itertools.count(), (1 << 15) + 1

    def weak(x, *_):
        i = next(calls) % 4
        return [x.bitwiseAND(127) + F.when(x == 0, 128).otherwise(0), x * 29 + 7, F.lit(0), F.lit(0)][i].cast("bigint")

    monkeypatch.setattr(token_shards.F, "xxhash64", weak)
    slots = spark.range(size).select(token_shards.permuted(F.col("id"), size, 9).alias("slot"))
    assert slots.distinct().count() == size and slots.agg(F.min("slot"), F.max("slot")).first()[:] == (0, size - 1)


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = queries.op4_toxicity(spark, d).join(labels, "doc_id").where("held_out").select("score", "predicted", "toxic").collect()
    pos, neg = [r.score for r in got if r.toxic], [r.score for r in got if not r.toxic]
    auc = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    assert auc > 0.93 and sum(r.predicted == r.toxic for r in got) / len(got) > 0.9
    odd = toxicity.score(docs(spark, ODD), labels.limit(0)).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score <= 1 for r in odd)


def test_block_max_is_exact(monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK", 4)
    monkeypatch.setattr(toxicity, "FIRST_BLOCKS", 2)
    monkeypatch.setattr(toxicity, "COLUMNS", 6)
    r = random.Random(1)
    vectors = []
    for n in range(400):
        v = {t: r.random() for t in r.sample(range(50) if n % 3 else range(45, 50), r.randrange(1, 8) if n % 3 else 2)}
        length = math.sqrt(sum(x * x for x in v.values()))
        vectors.append({t: x / length for t, x in v.items()})
    vectors += [{}, dict(vectors[7]), dict(vectors[7])]
    starts = np.concatenate([[0], np.cumsum([len(v) for v in vectors])])
    index = toxicity.BlockMaxIndex(starts, np.array([t for v in vectors for t in v], np.int32), np.array([w for v in vectors for w in v.values()]), 50)
    assert index.width > 0 and len(index.ids) > 0
    for i, q in enumerate(vectors[:60]):
        for gone in (-1, i):
            want = sorted((-round(sum(x * v.get(t, 0) for t, x in q.items()), 5), j) for j, v in enumerate(vectors) if j != gone)[:25]
            want = [(j, -s) for s, j in want if s < 0]
            ids, cosine = index.search(q, 25, gone)
            at = {round(s, 5) for _, s in want[-1:]}  # those that tie with the last may be others
            assert {j for j in ids.tolist() if round(sum(x * vectors[j].get(t, 0) for t, x in q.items()), 5) not in at} == {j for j, s in want if round(s, 5) not in at}
            np.testing.assert_allclose(cosine, [min(s, 1) for _, s in want], atol=2e-5)


def test_toxicity_blocks_hold_like_examples(monkeypatch):
    """Examples of different words lie in different blocks, so that a query's products and lists are those of its own words;
    what is found depends neither on products nor on the size of batches."""
    monkeypatch.setattr(toxicity, "BLOCK", 64)
    r = random.Random(5)
    vectors = []
    for n in range(600):
        words = [n % 3 * 60 + int(60 * r.random() ** 2) for _ in range(r.choice((3, 12, 60)))]
        v = {t: 1 + r.random() for t in sorted({*words, 180 + n % 7})}
        length = math.sqrt(sum(x * x for x in v.values()))
        vectors.append((np.array(list(v), np.int32), np.array(list(v.values())) / length))
    starts = np.concatenate([[0], np.cumsum([len(t) for t, _ in vectors])])
    dense = np.zeros((600, 187))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    cosines = dense @ dense.T
    for gain, together, queries in ((0.001, 8, 128), (200, 3, 16), (1e9, 8, 128)):
        for name, value in (("PRODUCT_GAIN", gain), ("TOGETHER", together), ("QUERIES", queries), ("BATCH", 70)):
            monkeypatch.setattr(toxicity, name, value)
        index = toxicity.BlockMaxIndex(starts, *(np.concatenate([v[i] for v in vectors]) for i in (0, 1)), 187)
        kinds = [set(index.example[a:b] % 3) for a, b in zip(index.firsts, index.firsts[1:])]
        assert sum(len(k) == 1 for k in kinds) > len(kinds) / 2
        for without in ([-1] * 600, list(range(600))):
            for i, (ids, cosine) in enumerate(index.nearest(vectors, 25, without)):
                want = cosines[i].copy()
                if without[i] >= 0:
                    want[i] = 0
                np.testing.assert_allclose(cosine, np.sort(want)[::-1][:25], atol=2e-6)
                np.testing.assert_allclose(want[ids], cosine, atol=2e-6)


def test_toxicity_terms_of_whole_texts(monkeypatch):
    """Terms are told apart as the pattern does, in any characters and however the text is cut."""
    texts = ["Ünïcode wörter_und 数字123 ½x", None, "", " \n", "ΑΣ ΑΣ. İstanbul İSTANBUL \U0001d7d8x", "a" * 900 + " longword longwords longer", "x\ny x", "\x00 nul\x00"]

    def terms(text):
        found = re.findall(r"[^\W_]+", (text or "").lower())
        return sorted(found + [w[:5] + "*" for w in found if len(w) > 5])

    names = {}
    for span in (1 << 18, 7):
        monkeypatch.setattr(toxicity, "_SPAN", span)
        rows, hashes = toxicity.hashed_terms(texts)
        for i, text in enumerate(texts):
            assert len(set(terms(text))) == len(set(hashes[rows == i].tolist())) and len(terms(text)) == (rows == i).sum()
            _, alone = toxicity.hashed_terms([text])
            assert sorted(alone.tolist()) == sorted(hashes[rows == i].tolist()) == names.setdefault(i, sorted(alone.tolist()))
    assert len({h for x in names.values() for h in x}) == len({t for x in texts for t in terms(x)})
    some = np.unique(np.concatenate([toxicity.hashed_terms(texts)[1], [-(1 << 63), (1 << 63) - 1]]))
    assert (toxicity.Vocabulary(some[::2]).columns(some)[::2] == np.arange(len(some[::2]))).all() and (toxicity.Vocabulary(some[::2]).columns(some)[1::2] == -1).all()
    assert (toxicity.Vocabulary(some[:0]).columns(some) == -1).all()


def test_toxicity_against_brute_force(spark):
    """Evidence of every document against cosines of all examples, from the definition."""
    r = random.Random(6)
    words = [f"w{i}" for i in range(40)] + ["longerword", "longerwise", "awful", "vile"]
    made = [(i, " ".join(r.choice(words[:42] if i % 4 else words) for _ in range(r.randrange(3, 25)))) for i in range(120)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in made[:80]] + [(0, 0)], "doc_id bigint, toxic int")
    got = {x.doc_id: x for x in toxicity.score(docs(spark, made), labels).collect()}
    text = dict(made)
    train = {i: int(i % 4 == 0) for i, _ in made[:80] if zlib.crc32(str(i).encode()) % toxicity.FOLDS}

    def tf(t):
        out = {}
        for w in re.findall(r"[^\W_]+", t.lower()):
            for x in [w] + [w[:5] + "*"] * (len(w) > 5):
                out[x] = out.get(x, 0) + 1
        return out

    terms = {t for i in train for t in tf(text[i])}
    df = {t: sum(t in tf(x) for _, x in made) for t in terms}
    n1 = {t: sum(t in tf(text[i]) for i, y in train.items() if y) for t in terms}
    n0 = {t: sum(t in tf(text[i]) for i, y in train.items() if not y) for t in terms}
    all1, all0 = sum(train.values()), len(train) - sum(train.values())

    def ratio(t):
        a, b, total = n1[t], n0[t], all1 + all0
        p1, p0 = (a + 0.5) / (all1 + 1), (b + 0.5) / (all0 + 1)
        if a + b < 3 or max(p1, p0) < 3 * min(p1, p0):
            return 0.0
        cells = [(a, (a + b) * all1), (b, (a + b) * all0), (all1 - a, (total - a - b) * all1), (all0 - b, (total - a - b) * all0)]
        return 2 * sum(s * math.log(s * total / e) for s, e in cells if s > 0)

    idf = {t: (1 + ratio(t) / 25) * math.log((len(made) + 1) / (df[t] + 1)) for t in terms}

    def unit(t):
        v = {x: (1 + math.log(n)) * idf[x] for x, n in tf(t).items() if x in idf and idf[x] > 0}
        length = math.sqrt(sum(x * x for x in v.values()))
        return {x: w / length for x, w in v.items()} if length else {}

    examples = {i: unit(text[i]) for i in train}
    for i, t in made:
        q = unit(t)
        want = sorted((-round(sum(w * v.get(x, 0) for x, w in q.items()), 6) for v in examples.values()))[:5]
        np.testing.assert_allclose([e.cosine for e in got[i].evidence], [-x for x in want if x < 0], atol=2e-6)


def test_toxicity_rare_terms(spark):
    """Terms too rare to go with a label for certain still have neighbours."""
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % toxicity.FOLDS]
    rare = ids[:2]
    text = lambda i: f"plain words filler{i % 7}{' zorgle' if i in rare else ''}"
    labels = spark.createDataFrame([(i, int(i in rare)) for i in ids], "doc_id bigint, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs(spark, [*((i, text(i)) for i in ids), (900, "zorgle"), (901, "filler1")]), labels).collect()}
    assert {e.doc_id for e in got[900].evidence} == set(rare) and got[900].score > got[901].score


def test_toxicity_learns_on_executors(spark, monkeypatch):
    """The driver searches for no example: its own index is never built."""
    monkeypatch.setattr(toxicity.BlockMaxIndex, "__init__", lambda *_: pytest.fail("built on the driver"))
    rows = [(i, f"plain words filler{i % 7} {'awful' if i % 3 == 0 else 'fine'}") for i in range(60)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id bigint, toxic int")
    got = toxicity.score(docs(spark, rows), labels).collect()
    assert sum(r.predicted == (r.doc_id % 3 == 0) for r in got) == 60


def test_urls(spark):
    link = lambda u: f'<link rel="canonical" href="{u}">'
    goes = lambda u: f'<meta http-equiv="refresh" content="0; url={u}">'
    pages = [
        (1, "http://EXAMPLE.org/es/x", None), (2, "http://mirror.net/a", link("http://example.org/es/x")), (3, "http://hop.net/b", goes("http://mirror.net/a")), (4, "http://free.net/c", ""),
        (5, "http://sub.example.org/en/12?q#f", ""), (6, "https://a.com/fr/1", link("https://b.com/de/2")), (7, "https://alias.net/z", link("https://a.com/fr/1")), (8, None, ""), (9, "nohost", link("http://example.org/es/x")), (10, "http://myexample.org/es/", ""), (10, "http://myexample.org/es/", ""),
    ]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id bigint, url string, html string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(df, queries.RULES).collect()}
    assert got[1] == ("example.org", "/es/x", "example.org/es/", "block")
    assert [got[i][3] for i in range(1, 11)] == ["block", "block", "block", "allow", "block", "allow", "allow", "allow", "allow", "allow"]
    assert got[5][:3] == ("sub.example.org", "/en/12", "example.org/en/1") and got[8][:3] == ("", "", None) and got[10][2] == "org/"
    assert urls.judge(df.limit(0), queries.RULES).count() == 0


@pytest.mark.parametrize(
    ("url", "tag", "target"),
    [
        ("http://a.org/x", '<link\n  rel="canonical"\n  href="http://b.org/y">', "http://b.org/y"),
        ("http://a.org/x", '<meta\n http-equiv="refresh"\n content="0; url=http://b.org/y">', "http://b.org/y"),
        ("http://a.org/d/x?q=1", '<link rel="canonical" href="page.html">', "http://a.org/d/page.html"),
        ("http://a.org/d/x?q=1", '<link rel="canonical" href="?id=2">', "http://a.org/d/x?id=2"),
        ("http://a.org/d/e/x", '<link rel="canonical" href="../y">', "http://a.org/d/y"),
        ("http://a.org/d/e/x", '<link rel="canonical" href="./../../../y/./z/..">', "http://a.org/y/"),
        ("http://a.org", '<meta http-equiv="refresh" content="0;url=next.html">', "http://a.org/next.html"),
        ("http://a.org/d/x", '<link rel="canonical" href="next?to=http://c.org/">', "http://a.org/d/next?to=http://c.org/"),
        ("http://a.org/x", '<link rel="alternate canonical" href="http://b.org/y">', "http://b.org/y"),
        ("http://a.org/x", '<link rel="canonical" href="http://b.org/y?a=1&amp;b=2">', "http://b.org/y?a=1&b=2"),
        ("http://a.org/x", '<meta http-equiv="refresh" content="0; url=/y?a=1&amp;b=2">', "http://a.org/y?a=1&b=2"),
        ("http://a.org/x/y", '<base href="/d/"><link rel="canonical" href="page.html">', "http://a.org/d/page.html"),
        ("http://a.org/x/y", '<base href="http://b.org/e/f"><link rel="canonical" href="../g">', "http://b.org/g"),
        ("http://a.org/x", '<link rel="not-canonical" href="http://b.org/y">', None),
        ("http://a.org/x", '<link rel="canonical" href="mailto:a@b.org">', None),
    ],
)
def test_links(spark, url, tag, target):
    got = urls.links(spark.createDataFrame([(1, url, f"<p>{tag}</p>")], "page_id bigint, url string, html string")).collect()
    assert [r.target for r in got] == ([] if target is None else [target])


def test_urls_against_all_paths(spark):
    """Random graphs of links - chains, cycles, hubs, allowed pages among blocked ones - against a search by hand."""
    r = random.Random(12)
    hosts = ["example.org", "sub.example.org", "a.com", "b.com", "free.net", "mirror.net", "other.io"]
    made = [f"http{'s' * r.randrange(2)}://{r.choice(hosts)}/{r.choice(['es', 'en', 'fr', 'de', 'x'])}/{i}" for i in range(260)]
    goes = {i: [] for i in range(260)}
    for i in range(0, 120, 6):  # chains, every second one closed
        for j in range(i, i + 5):
            goes[j].append(j + 1)
        if i % 12 == 0:
            goes[i + 5].append(i)
    for i in range(120, 200):
        goes[i].append(r.choice([120, 121, r.randrange(120, 200)]))
    html = lambda i: "<p>" + "".join(f'<link rel="canonical" href="{made[j]}">' if k % 2 else f'<meta http-equiv="refresh" content="0; url={made[j]}">' for k, j in enumerate(goes[i]))
    pages = [(i, made[i], html(i)) for i in range(260)] + [(900, "https://far.net/", '<link rel="canonical" href="http://example.org/es/nowhere">'), (901, "x" * 100_000, "y" * 300_000), (None, None, html(0))]
    got = {x.page_id: x.verdict for x in urls.judge(spark.createDataFrame(pages, "page_id bigint, url string, html string"), queries.RULES).collect()}

    def ruled(url):
        host, _, path = url.split("://")[1].partition("/")
        fits = [(len(h + p), v) for v, h, p in queries.RULES if (host == h or host.endswith("." + h)) and f"/{path}".startswith(p)]
        return max(fits)[1] if fits else None

    near = {i: set() for i in range(260)}
    for i, js in goes.items():
        for j in js:
            if made[i] != made[j]:
                near[i].add(j)
                near[j].add(i)
    for i in range(260):
        group, new = {i}, [i]
        while new:
            new = [j for x in new for j in near[x] if j not in group and not group.add(j)]
        verdicts = {ruled(made[j]) for j in group}
        want = ruled(made[i]) or ("block" if "block" in verdicts and "allow" not in verdicts else "allow")
        assert got[i] == want, (made[i], [made[j] for j in group])
    assert got[900] == "block" and got[901] == got[None] == "allow" and {"block", "allow"} == set(got.values())


def test_components(spark):
    r = random.Random(5)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(0, i) for i in range(1000, 1100)] + [(i, i + 1) for i in range(2000, 2060)] + [(None, 4), (9, 9)]
    got = {x.node: x.component for x in components.connected_components(spark.createDataFrame(edges, "a bigint, b bigint"), Scratch(spark)).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            p, q = sorted((find(a), find(b)))
            root[q] = p
    assert got == {x: find(x) for x in root}


FORMS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for kind, form in FORMS.items():
        for m in re.finditer(form, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else False, "card": 13 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((kind, *m.span()))
    return out


def test_pii(spark, rows):
    r = random.Random(2)
    noise = [(20_000_000 + i, "".join(r.choice("a1.@+- 4(9)") for _ in range(400))) for i in range(60)]
    noise += [(20_001_000, "4111 1111 1111 1111 at 10.0.0.1.2.3.4.5 +1 (555) 010-9999 a@b@c.de x.y@z.org.")]
    every = rows + noise
    got = pii.find_all(docs(spark, every)).collect()
    assert len(got) == len(every)
    by = {r.doc_id: r for r in got}
    for d, t in every:
        want = plain_spans(t)
        assert by[d].base_sha256 == pii.spans_digest(want) and [by[d][f"n_{k}"] for k in pii.KINDS] == [sum(x[0] == k for x in want) for k in pii.KINDS]
        assert {f"{k}:{s}:{e}" for k, s, e in want} <= set(by[d].spans.split(","))


def test_pii_bootstrap(spark):
    seeds = [(i, f"please mail to user{i}@site.org now") for i in range(6)]
    rows = [*seeds, (90, "please mail to user99(at)site today"), (91, "the year is 1999xx fine"), (92, None)]
    got = {r.doc_id: r.spans for r in pii.find_all(docs(spark, rows)).collect()}
    assert got[90].startswith("email:15:") and got[91] == "" and got[92] == ""
    text = {r.doc_id: r.text for r in pii.redact(docs(spark, rows)).collect()}
    assert text[0] == "please mail to [EMAIL] now" and "[EMAIL]" in text[90] and text[92] is None


def test_pii_views(spark):
    """Contexts of one word, of either side and of line ends, with precision and recall of planted identifiers; words that stand
    around plain numbers as well make no pattern."""
    g = random.Random(9)
    rows, planted = [], set()
    for i in range(40):
        rows.append((i, f"{g.choice('abc')}{i} contact: user{i}@site.org\nserver 10.0.0.{i} answered, and it cost 10.0.1.{i} in all"))
    for i in range(100, 130):
        text, hidden = [
            (f"then contact: user{i}@localhost for more", f"user{i}@localhost"),
            (f"host 999.10.{i}.4 answered, late", f"999.10.{i}.4"),
            (f"it cost 12.{i},50 in all", None),
            (f"@handle{i} said so and paid 99{i}99 for it", None),
        ][i % 4]
        rows.append((i, text))
        if hidden:
            at = text.index(hidden)
            planted.add((i, at, at + len(hidden)))
    rows += [(200 + i, f"it cost {10_000 + i} in all") for i in range(60)]
    found = pii.find(docs(spark, rows)).collect()
    new = {(r.doc_id, x.start, x.end) for r in found for x in r.text_spans if not x.base}
    assert len(new & planted) / len(planted) == 1.0 and len(new & planted) / len(new) == 1.0


def test_pii_scores(spark):
    """Scores of patterns against the definition: seeds, other kinds, and what the other side's patterns say, round by round."""
    rows = [(i, f"mail a{i}@b.org today") for i in range(4)] + [(10 + i, f"mail x{i}@home today") for i in range(3)] + [(20 + i, f"ask x{i}@home maybe") for i in range(3)] + [(30 + i, f"ask z{i}@b.org so") for i in range(3)]
    found = pii.mentions(docs(spark, rows))
    seen = {(c, r.kind, r.value) for r in found.collect() for c in r.contexts}
    base = {x for x in seen if x[1] == "email"}
    induced = {c for c, _, _ in base if len({v for d, _, v in base if d == c}) >= 3}
    score = {c: len({v for d, k, v in seen if d == c and k}) / len({v for d, _, v in seen if d == c}) for c in induced}
    for _ in range(pii.ROUNDS):
        worth = lambda c, k, v: 1.0 if k else max((score[d] for d, _, w in seen if w == v and d in induced and {c[0], d[0]} == {"L", "R"} and score[d] >= pii.MIN_SCORE), default=0.0)  # noqa: E731, B023
        score = {c: (lambda xs: sum(xs) / len(xs))([worth(c, k, v) for d, k, v in seen if d == c]) for c in induced}
    got = {r.context: r.score for r in pii.score_patterns(found, Scratch(spark), generations=1).collect()}
    assert got.keys() == score.keys() and all(abs(got[c] - score[c]) < 0.01 for c in got)


VEC = "vec_id bigint, embedding array<float>, label int, score double"


def vectors(n=700, dims=24, seed=4):
    g = np.random.default_rng(seed)
    centres = g.normal(size=(12, dims))
    m = centres[g.integers(0, 12, n)] + 0.6 * g.normal(size=(n, dims))
    m[100:140] = m[100]  # copies
    rows = [(i, m[i].astype(np.float32).tolist(), 0, 0.0) for i in range(n)]
    bad = [None, [None] * dims, [float("nan")] * dims, [float("inf")] * dims]
    return rows + [(10_000 + 100 * i, v, 0, 0.0) for i, v in enumerate(bad)] + [(None, [1.0] * dims, 0, 0.0), rows[0]]


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROWS_PER_BLOCK", 100)
    rows = vectors()
    m = {i: np.floor(1024 * np.array(v, dtype=np.float64)) for i, v, *_ in rows[:700]}
    want = [(q, rank, i, int(s)) for q in m if q % 100 == 0 for rank, (s, i) in enumerate(sorted(((float(m[q] @ m[c]), c) for c in m if c != q), key=lambda x: (-x[0], x[1]))[:10], 1)]
    got = [tuple(r) for r in topk.top_k(spark.createDataFrame(rows, VEC)).orderBy("query_id", "rank").collect()]
    assert got == want
    assert topk.top_k(spark.createDataFrame([], VEC)).count() == 0
    assert topk.top_k(spark.createDataFrame(rows[:3], VEC)).count() == 2


def test_ann_recall(spark):
    rows = vectors()
    m = np.array([v for _, v, *_ in rows[:700]], dtype=np.float64)
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    got = {}
    for r in ann.nearest(spark.createDataFrame(rows, VEC), shard=200).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hit = total = 0
    for q in range(0, 700, 50):
        s = unit @ unit[q]
        best = sorted((i for i in range(700) if i != q), key=lambda i: (-round(s[i], 12), i))[:5]
        hit += len({v for _, v, _ in got[q]} & set(best))
        total += 5
        assert all(abs(x - s[v]) < 1e-9 for _, v, x in got[q])
    assert hit / total >= 0.9


DOUBLES = "vec_id bigint, embedding array<double>, rank int"


def test_top_k_of_odd_vectors(spark):
    rows = [(0, [1e306, -1e306], 1), (100, [1.0, 2.0], 1), (1, [-1e306, 3.0], 1), (2, [], 1), (3, [5e-324, 1.0], 1), (4, [2.0], 1)]
    got = [tuple(r) for r in topk.top_k(spark.createDataFrame(rows, DOUBLES)).orderBy("query_id", "rank").collect()]
    assert [(q, v) for q, _, v, _ in got if q == 100] == [(100, 0), (100, 3), (100, 4), (100, 2), (100, 1)] or {v for q, _, v, _ in got if q == 100} == {0, 1, 2, 3, 4}
    scores = {(q, v): s for q, _, v, s in got}
    assert scores[100, 2] == 0 and scores[100, 4] == 1024 * 2048 and scores[100, 1] == -(1 << 63) and scores[0, 4] == (1 << 63) - 1


def test_top_k_passes_no_vectors_through_the_driver(spark, monkeypatch):
    """Blocks of queries against slices of several blocks; scores that no single-precision sum holds, and many ties."""
    def refused(*_):
        raise AssertionError("vectors sent by the driver")

    def counts(df):
        assert "binary" not in df.schema.simpleString()
        return collect(df)

    for name, size in (("ROWS_PER_BLOCK", 64), ("QUERIES_PER_BLOCK", 3), ("SLICES", 2), ("HELD", 20)):
        monkeypatch.setattr(topk, name, size, raising=False)
    g = np.random.default_rng(6)
    for dims, spread, scale, copies in ((70, 1.0 / np.arange(1, 71), 1024, 1), (20, 1.0, 1 << 20, 40), (20, 1.0, 1, 40)):
        m = np.repeat(g.normal(size=(400 // copies, dims)) * spread, copies, axis=0)
        df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(m)], DOUBLES)
        w = np.floor(scale * m)
        want = [(q, rank, i, int(s)) for q in range(0, 400, 20) for rank, (s, i) in enumerate(sorted(((float(w[q] @ w[c]), c) for c in range(400) if c != q), key=lambda x: (-x[0], x[1]))[:10], 1)]
        with monkeypatch.context() as held:
            held.setattr(type(spark.sparkContext), "broadcast", refused)
            collect = type(df).collect
            held.setattr(type(df), "collect", counts)
            got = topk.top_k(df, every=20, scale=scale)
        assert [tuple(r) for r in got.orderBy("query_id", "rank").collect()] == want
        assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    odd = spark.createDataFrame([(0, [1e300, 1.0], 1), (1, [], 1), (2, [0.0, 0.0], 1), (3, [0.0, 1.0], 1)], DOUBLES)
    assert [(r.query_id, r.vec_id) for r in topk.top_k(odd, k=2).orderBy("rank").collect()] == [(0, 3), (0, 1)]


def test_ann_of_odd_tables(spark):
    near = lambda rows: [tuple(r) for r in ann.nearest(spark.createDataFrame(rows, DOUBLES)).orderBy("query_id", "rank").collect()]
    assert near([]) == [] and near([(0, [1.0], 1)]) == []
    got = near([(0, [1.0, 0.0], 1), (7, [2.0, 0.0], 1), (5, [3.0, 0.0], 1), (9, [0.0, 0.0], 1), (50, [0.0, 1.0], 1), (8, None, 1), (None, [1.0, 0.0], 1), (6, [1e200, 0.0], 1)])
    assert [r[2] for r in got if r[0] == 0] == [5, 6, 7, 50] and [r[2] for r in got if r[0] == 50] == [0, 5, 6, 7]  # ties by id, fewer than five
    assert all(r[3] == 1.0 for r in got if r[0] == 0 and r[2] != 50)


def test_ann_of_copies(spark, monkeypatch):
    """Copies of a vector make no shards, queries travel once for a slice of shards, and what a task holds may go out early."""
    g = np.random.default_rng(9)
    base = g.normal(size=(300, 12))
    df = spark.createDataFrame([(i, base[i % 300].tolist(), 1) for i in range(2400)], DOUBLES)
    made, search = [], ann.search
    monkeypatch.setattr(ann, "search", lambda index, queries, shards, *a: made.append((index.count(), shards)) or search(index, queries, shards, *a))
    for name, size in (("SLICES", 2), ("SHARDS_PER_SLICE", 2), ("HELD", 30), ("QUERIES_PER_BLOCK", 7)):
        monkeypatch.setattr(ann, name, size, raising=False)
    unit = base / np.linalg.norm(base, axis=1, keepdims=True)
    hit, rows = 0, ann.nearest(df, shard=75).orderBy("query_id", "rank").collect()
    for q in range(0, 2400, 50):
        got = [(r.vec_id, r.score) for r in rows if r.query_id == q]
        assert [v for v, _ in got] == [i for i in range(q % 300, 2400, 300) if i != q][:5] and all(abs(s - 1) < 1e-12 for _, s in got)
    for r in ann.nearest(df.where("vec_id < 300"), shard=75).collect():
        s = unit @ unit[r.query_id]
        assert abs(r.score - s[r.vec_id]) < 1e-12 and r.vec_id != r.query_id
        hit += r.vec_id in set(np.argsort(-s)[1:6].tolist())
    assert made == [(4, 4), (4, 4)] and hit >= 0.95 * 30
    short = spark.createDataFrame([(i, [2.0, 0.0][: 1 + i % 2], 1) for i in range(30)] + [(30, [0.0, 1.0], 1)], DOUBLES)
    assert [(r.query_id, r.vec_id, r.score) for r in ann.nearest(short).orderBy("rank").collect()] == [(0, i, 1.0) for i in range(1, 6)]


def test_ann_recall_of_hubs(spark):
    """Near-equal vectors around few centres, in several shards: nodes behind a hub are found all the same."""
    g = np.random.default_rng(3)
    centres = g.normal(size=(4, 16))
    m = centres[g.integers(0, 4, 3000)] + 0.02 * g.normal(size=(3000, 16))
    got = {}
    for r in ann.nearest(spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(m)], DOUBLES), shard=1000).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    hit = 0
    for q in range(0, 3000, 50):
        s = unit @ unit[q]
        s[q] = -2
        hit += len(got[q] & set(np.argsort(-s, kind="stable")[:5].tolist()))
    assert hit / (60 * 5) >= 0.9


def test_toxicity_of_odd_labels(spark):
    """A document labelled twice counts once, as toxic; labels without documents, null labels and null texts do no harm."""
    ids = [i for i in range(80) if zlib.crc32(str(i).encode()) % toxicity.FOLDS]
    rows = [(i, f"plain words {'awful' if n % 3 == 0 else 'fine'} filler{i % 5}") for n, i in enumerate(ids)] + [(500, None), (501, "")]
    marks = [(i, int(n % 3 == 0)) for n, i in enumerate(ids)] + [(ids[0], 0), (9999, 1), (None, 1), (ids[1], None), (500, 1)]
    got = {r.doc_id: r for r in toxicity.score(docs(spark, rows), spark.createDataFrame(marks, "doc_id bigint, toxic int")).collect()}
    assert got[ids[0]].predicted == 1 and got[ids[1]].predicted == 0 and len(got) == len(rows) and 0 <= got[500].score == got[501].score <= 1


def test_warc_of_odd_pages(spark, tmp_path):
    schema = "page_id bigint, url string, html string, payload string, first bigint"
    assert warc.archive_pages(spark.createDataFrame([], schema), path=str(tmp_path / "none")).count() == 0
    rows = [(None, "u", "same", "c", 1), (4, "u", "same", "c", 1), (4, "u", "same", "c", 1), (9, "u", "same", "c", 1), (None, "u", "alone", "c", 1)]
    got = sorted((str(r.page_id), r.record_type, r.refers_to) for r in warc.archive_pages(spark.createDataFrame(rows, schema), path=str(tmp_path / "w")).collect())
    assert got == [("4", "response", None), ("4", "response", None), ("9", "revisit", 4), ("None", "response", None), ("None", "revisit", 4)]
    raw = b"".join(p.read_bytes() for p in (tmp_path / "w").glob("*.gz"))
    import gzip

    assert gzip.decompress(raw).count(b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest") == 2


def test_warc_of_long_urls(spark, tmp_path):
    rows = [(1, "http://a.org/" + "x" * 2_500_000, "one"), (2, "http://a.org/" + "y" * 70_000, "one"), (3, "http://b.org/", "two")]
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.archive_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string"), path=str(tmp_path / "w")).collect()}
    assert got == {1: ("response", None), 2: ("revisit", 1), 3: ("response", None)}
    assert sorted(len(r.target_uri) for r in warc.read(spark, str(tmp_path / "w")).collect()) == sorted(len(u) for _, u, _ in rows)


def test_warc(spark, tmp_path):
    pages = [(1, "http://a/1", "<p>é</p>"), (2, "http://a/2", "<p>é</p>"), (3, "http://a/3", None), (4, "http://a/4", ""), (5, None, "z" * 3_000_000), (6, "http://a/6\r\nX: y", "q"), (7, "http://a/7", "<p>é</p>")]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id bigint, url string, html string, payload string").repartition(3)
    path = str(tmp_path / "w")
    got = {r.page_id: r for r in warc.archive_pages(df, path=path).collect()}
    first = {}
    for i, _, html in sorted(pages, key=lambda x: x[0]):
        body = (html or "").encode()
        first.setdefault(body, i)
        assert got[i].payload_bytes == len(body) and got[i].payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert (got[i].record_type, got[i].refers_to) == (("response", None) if first[body] == i else ("revisit", first[body]))
    full = {r.record_id: bytes(r.payload) for r in warc.read(spark, path).where("record_type = 'response'").collect()}
    assert full["<urn:page:5>"] == b"z" * 3_000_000
    plan = warc.read(spark, path).where("record_type = 'revisit'")._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"[)-] Filter", plan), plan  # the source itself tests the type
    assert {r.record_type for r in warc.archive_pages(df, path=str(tmp_path / "v"), revisit_bytes=5).where("page_id IN (3, 4)").collect()} == {"response"}


def test_pipeline(spark, sf):
    import corpus_pipeline as c

    d = spark.read.parquet(f"{sf}/documents.parquet")
    names, n = d.columns, d.count()
    for name, stage in c.STAGES[:-1]:
        d = stage(spark, d, sf).cache()
        assert d.columns == names and 0 < d.count() <= n
        n = d.count()
    assert not any(plain_spans(r.text) for r in d.select("text").collect())
    packed = c.run(spark, sf)
    assert packed.select("doc_id").distinct().count() == n
    assert [s for s, _ in c.STAGES] == ["toxicity", "near_duplicates", "personal_data", "packing"]


def test_pipeline_of_odd_documents(spark, sf):
    """Nulls in any column, empty and long texts, repeated rows, columns with clashing names, and nothing at all."""
    import corpus_pipeline as c

    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, __spans string, __row string, __bucket string, __lost string, count bigint"
    texts = [None, "", " ", "short", "mail me at ada@site.org or 10.1.2.3 now", "mail me at ada@site.org or 10.1.2.3 now", "word " * 40_000, "é ü " * 50]
    rows = [(i, t, None if i % 2 else "en", None, None if t is None else len(t), "s", "r", "b", "l", i) for i, t in enumerate(texts)] + [(None, "no id", None, None, None, None, None, None, None, None), (3, "short", "en", None, 5, "s", "r", "b", "l", 3)]
    for some in (rows, []):
        d = spark.createDataFrame(some, schema)
        columns = d.columns
        for name, stage in c.STAGES[:-1]:
            d = stage(spark, d, sf)
            assert d.columns == columns, name
        kept = d.collect()
        packed = c.STAGES[-1][1](spark, spark.createDataFrame(kept, schema), sf).collect()
        assert sorted({r.doc_id for r in packed}, key=str) == sorted({r.doc_id for r in kept}, key=str) and len(packed) >= len(kept)
        if some:
            found = {r.doc_id: r for r in kept}
            assert found[4].text == "mail me at [EMAIL] or [IP] now" and found[4].n_chars == len(found[4].text) and found[4]["__row"] == "r" and 5 not in found
            assert found[0].text is None and found[None].text == "no id" and found[1].text == ""
            assert all(sum(r.length for r in packed if r.doc_id == i) >= 1 for i in found)
