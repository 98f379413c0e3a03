"""Toxicity from the nearest labelled examples, by exact cosine of weighted TF-IDF vectors with block-max inverted lists.

Terms are words (runs of letters and digits, lower-cased) and the first five characters of longer words: all of those of a
bounded sample of the labelled rows, told apart by 64-bit hashes. How rare a term is is counted over all documents; terms
that go with the label in the sample weigh more, and none is left out. The sample's vectors form an inverted index over
blocks of examples: a term's list holds its largest weight in each block, so a block whose bound lies below the k-th best
cosine so far is not scored. Blocks hold examples of like words. Terms of many of them are columns of a dense matrix for the
queries that share many, and their share of the bound is exact.
Neighbours vote with weights that fall with their distance, scaled to the label's frequency among all training rows;
leave-one-out votes of the sample calibrate the score.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, map_batches, parts, release_memory

MAX_EXAMPLES = 8_000  # of each label; the index and every broadcast are bounded by it
UNIT_RATIO = 25.0  # of a term's log-likelihood; a chance below 1e-6, as very many terms are tried. Doubles a term's weight
NEIGHBOURS = 25
FOLDS = 5
BATCH = 640
SOME_BYTES = 1 << 20
BLOCK = 1024
FIRST_BLOCKS = 2
PRECISION = 2.0**-23  # single precision loses no more than this for each term of a query, in a cosine
COLUMNS = 2000  # of a tier, at most
TIERS = np.array([0.15, 0.06])  # parts of a group's examples that hold a column's term, at least
PRODUCT_GAIN = 200  # entries of a matrix product that take as long as one posting
QUERIES = 128  # of one matrix product
TOGETHER = 8  # queries whose bounds are found at once
LOW = int(sys.byteorder == "big")
GROUPS = 8
GROUP_TERMS = 512
GROUP_EXAMPLES = 4096
GROUP_ROUNDS = 6
LANES = 64
ROWS = 1024
DIGITS = 6
_STEM = 5
_SPAN = 1 << 18
_STEP = 0x9E3779B97F4A7C15  # odd, as its powers have to have inverses
_MASK = (1 << 64) - 1


@cache
def _letters() -> np.ndarray:
    """Whether each character is a letter or digit."""
    return np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)


@cache
def _mixed() -> np.ndarray:
    """A number of 64 bits for each character."""
    return np.random.default_rng(17).integers(0, _MASK, 0x110000, np.uint64, endpoint=True)


@cache
def _powers(step: int, size: int) -> np.ndarray:
    out = np.full(size, step, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _finished(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h.view(np.int64)


def _word_hashes(codes: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of words in one span of characters, and of the stems of those numbered behind them: differences of a running
    polynomial of the characters, moved to one origin."""
    size = max(_SPAN, 1 << (len(codes) - 1).bit_length())
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(_mixed()[codes] * _powers(_STEP, size)[: len(codes)], out=total[1:])
    back = _powers(pow(_STEP, -1, 1 << 64), size)[start]
    long = np.nonzero(stop - start > _STEM)[0]
    stems = (total[start[long] + _STEM] - total[start[long]]) * back[long] ^ np.uint64(_STEP)
    return _finished((total[stop] - total[start]) * back), _finished(stems), long


def hashed_terms(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the text, hash) of each occurrence of a term: words, and the stems of longer ones."""
    lowered = [t.lower() if t else "" for t in texts]
    codes = np.frombuffer("\n".join([*lowered, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = np.zeros(len(codes) + 2, np.int8)
    inside[1:-1] = _letters()[codes]
    edges = np.diff(inside)
    starts, stops = np.nonzero(edges > 0)[0], np.nonzero(edges < 0)[0]
    ends = np.cumsum([len(t) + 1 for t in lowered])
    rows = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(starts, ends), prepend=0))
    found, owners, first = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(stops, starts[first] + _SPAN, "right")))
        at, to = starts[first], stops[last - 1]
        words, stems, long = _word_hashes(codes[at:to], starts[first:last] - at, stops[first:last] - at)
        found += [words, stems]
        owners += [rows[first:last], rows[first:last][long]]
        first = last
    return np.concatenate(owners), np.concatenate(found)


def _ranges(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges, one behind the other, and how many each has."""
    n = stop - start
    return np.arange(n.sum()) + np.repeat(start - np.cumsum(n) + n, n), n


class Vocabulary:
    """Term -> column, by sorted hashes, whose leading bits say where to look; term frequencies of texts over it."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes

    def __getstate__(self) -> dict:
        return {"hashes": self.hashes}

    @cached_property
    def _shift(self) -> np.uint64:
        return np.uint64(64 - max(len(self.hashes), 2).bit_length())

    def _bucket(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes.view(np.uint64) ^ np.uint64(1 << 63)) >> self._shift).astype(np.int64)

    @cached_property
    def _firsts(self) -> np.ndarray:
        return np.append(0, np.cumsum(np.bincount(self._bucket(self.hashes), minlength=1 << (64 - int(self._shift))))).astype(np.int32)

    def columns(self, hashes: np.ndarray) -> np.ndarray:
        """The column of each term, -1 where it has none."""
        out = np.full(len(hashes), -1, np.int32)
        bucket = self._bucket(hashes)
        at, stop = self._firsts[bucket], self._firsts[bucket + 1]
        left = np.nonzero(at < stop)[0]
        at, stop, wanted = at[left], stop[left], hashes[left]
        while len(left):
            same = self.hashes[at] == wanted
            out[left[same]] = at[same]
            more = ~same & (at + 1 < stop)
            left, at, stop, wanted = left[more], at[more] + 1, stop[more], wanted[more]
        return out

    def frequencies(self, texts: list[str | None]) -> Frequencies:
        rows, hashes = hashed_terms(texts)
        columns = self.columns(hashes)
        known = columns >= 0
        keys, times = np.unique((rows[known] << 32) | columns[known], return_counts=True)
        return np.searchsorted(keys >> 32, np.arange(len(texts) + 1)), (keys & 0xFFFFFFFF).astype(np.int32), times.astype(np.int32)


Frequencies = tuple[np.ndarray, np.ndarray, np.ndarray]  # where each text starts, columns (rising), how often


def training_rows(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of labelled rows outside the held-out fold; a doc_id labelled twice counts once, as toxic if any is."""
    rows = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)")
    return rows.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


Vector = tuple[np.ndarray, np.ndarray]  # columns, weights
Knots = tuple[np.ndarray, np.ndarray]


def _groups(starts: np.ndarray, terms: np.ndarray, n_terms: int) -> np.ndarray:
    """A group for each example, by the frequent terms that it holds: a few rounds of spherical k-means over evenly spaced
    examples, from such as are least alike."""
    size, times = len(starts) - 1, np.bincount(terms, minlength=n_terms)
    column = np.full(n_terms, -1, np.int32)
    common = np.argsort(-times, kind="stable")[:GROUP_TERMS]
    column[common] = np.arange(len(common))

    def unit(rows: np.ndarray) -> np.ndarray:
        at, n = _ranges(starts[rows], starts[rows + 1])
        col, out = column[terms[at]], np.zeros((len(rows), GROUP_TERMS), np.float32)
        out[np.repeat(np.arange(len(rows)), n)[col >= 0], col[col >= 0]] = 1
        return out / np.maximum(np.sqrt(out.sum(1, keepdims=True)), 1)

    some = unit(np.arange(0, size, max(1, size // GROUP_EXAMPLES)))
    telling = np.count_nonzero(some, axis=1)
    telling = telling >= np.median(telling) / 4
    middle = some.sum(0)
    centres, alike = np.zeros((0, GROUP_TERMS), np.float32), some @ middle / np.sqrt(middle @ middle + 1e-9) - 2
    for _ in range(GROUPS):
        centres = np.vstack([centres, some[np.argmax(np.where(telling, -alike, -9.0))]])
        alike = np.maximum(alike, some @ centres[-1])
    for _ in range(GROUP_ROUNDS):
        group = np.argmax(some @ centres.T, axis=1)
        sums = np.stack([some[group == g].sum(0) for g in range(GROUPS)])
        lengths = np.sqrt((sums * sums).sum(1, keepdims=True))
        centres = np.where(lengths > 0, sums / np.maximum(lengths, 1e-9), centres)
    return np.concatenate([np.argmax(unit(np.arange(a, min(a + ROWS, size))) @ centres.T, axis=1) for a in range(0, size, ROWS)])


class BlockMaxIndex:
    """Inverted lists over blocks of at most ``BLOCK`` examples of one group; a list's entries are its parts within blocks, with
    their largest weights. Terms that many examples of a group hold are its columns, in tiers. Where a query shares many
    postings with a tier, their share of the cosine is a matrix product for all such queries of a batch, over a block that is
    spread out at a time, and stands in the block's bound as it is. Weights are in single precision; products are filled up
    to one size, so that a query's cosines do not depend on the others."""

    def __init__(self, starts: np.ndarray, terms: np.ndarray, weights: np.ndarray, n_terms: int):
        """Unit vectors, one behind the other: where each starts, its terms and weights. Neither is kept."""
        self.size = len(starts) - 1
        if not self.size:
            return
        group = _groups(starts, terms, n_terms)
        self.example = np.argsort(group, kind="stable")  # of each place
        self.place = np.argsort(self.example)
        sizes = np.bincount(group, minlength=GROUPS)
        bounds = np.append(0, np.cumsum(sizes))
        firsts = np.concatenate([np.arange(a, b, BLOCK) for a, b in zip(bounds, bounds[1:], strict=False)])
        self.group = np.searchsorted(bounds, firsts, "right") - 1  # of each block
        self.firsts, self.width = np.append(firsts, self.size), -(-self.size // LANES) * LANES
        key = terms.astype(np.int64) * GROUPS
        key += np.repeat(group, np.diff(starts))
        times = np.bincount(key, minlength=n_terms * GROUPS).reshape(n_terms, GROUPS)
        # columns: of each term that is one of some group, by group: its tier (-1: none), its number there
        least = np.multiply.outer(TIERS, sizes)
        frequent = np.nonzero((times >= np.maximum(least[-1], 1)).any(axis=1))[0]
        times = times[frequent].astype(np.int32)
        self.frequent = np.full(n_terms, -1, np.int32)
        self.frequent[frequent] = np.arange(len(frequent))
        self.unit, self.column = np.full(times.shape, -1, np.int16), np.zeros(times.shape, np.int16)
        self.widths = np.zeros(GROUPS * len(TIERS), np.int64)
        for unit in range(len(self.widths)):
            g, tier = divmod(unit, len(TIERS))
            fits = (times[:, g] >= max(least[tier, g], 1)) & (self.unit[:, g] < 0)
            chosen = np.nonzero(fits)[0]
            chosen = chosen[np.argsort(-times[chosen, g], kind="stable")[:COLUMNS]]
            self.unit[chosen, g], self.column[chosen, g], self.widths[unit] = unit, np.arange(len(chosen)), len(chosen)
        self.postings = times
        self.worth = np.repeat(sizes, len(TIERS)) * self.widths / PRODUCT_GAIN  # postings that are worth a product
        # lists by term, those of columns behind all others
        at, g = self.frequent[terms], (key % GROUPS).astype(np.int8)
        dense = at >= 0
        dense[dense] = self.unit[at[dense], g[dense]] >= 0
        del at, g
        key = terms.astype(np.int64)
        key += dense * np.int64(n_terms)
        del dense
        key <<= 32
        key |= np.repeat(self.place, np.diff(starts))
        order = np.argsort(key).astype(np.int32)
        weights = weights[order].astype(np.float32, copy=False)
        key = key[order]
        del order
        listed = (key >> 32).astype(np.int32)
        key &= 0xFFFFFFFF
        block = (np.searchsorted(firsts, np.arange(self.size), "right") - 1).astype(np.int32)[key]
        key <<= 32
        key |= weights.view(np.uint32)
        self.ids = key  # places, with the weights' bits behind them
        new = np.nonzero(np.concatenate([[True], (listed[1:] != listed[:-1]) | (block[1:] != block[:-1])]))[0] if len(listed) else np.zeros(0, np.int64)
        self.entry_block, listed = block[new], listed[new]
        del block
        self.entry_max = np.maximum.reduceat(weights, new) if len(new) else np.zeros(0, np.float32)
        self.entry_start = np.append(new, len(self.ids)).astype(np.int32)
        self.term_entry = np.searchsorted(listed, np.arange(n_terms + 1)).astype(np.int32)
        first = int(self.term_entry[-1])  # of columns
        pair = self.frequent[listed[first:] - n_terms].astype(np.int64) * GROUPS + self.group[self.entry_block[first:]]
        self.pair_entry = first + np.searchsorted(pair, np.arange(len(frequent) * GROUPS + 1))
        # entries of columns by unit and block
        unit = self.unit.reshape(-1)[pair]
        order = np.lexsort((self.entry_block[first:], unit))
        self.dense, self.dense_column = (first + order).astype(np.int32), self.column.reshape(-1)[pair[order]]
        self.dense_start = np.searchsorted(unit[order].astype(np.int64) * len(self.firsts) + self.entry_block[first:][order], np.arange(len(self.widths) * len(self.firsts) + 1))

    def _spread(self, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and weights of ranges of postings."""
        at = np.repeat(start - np.cumsum(n) + n, n)
        at += np.arange(len(at))
        found = self.ids.take(at, mode="clip")
        weights = found.view(np.float32)[LOW::2]
        return found >> 32, weights

    def _shares(self, batch: list[Vector]) -> tuple[np.ndarray, list[Vector]]:
        """Each place's share of the cosine with each query from products, and for each query the lists of columns that no
        product covers, with its weights."""
        units = len(self.widths)
        row = np.repeat(np.arange(len(batch)), [len(t) for t, _ in batch])
        at = self.frequent[np.concatenate([t for t, _ in batch])]
        here = at >= 0
        row, at, weight = row[here], at[here], np.concatenate([w for _, w in batch])[here].astype(np.float32)
        number = np.arange(len(at))
        held = [number[some] for g in range(GROUPS) for some in [self.unit[at, g] >= 0]]
        cells = [row[x] * units + self.unit[at[x], g] for g, x in enumerate(held)]
        made = sum(np.bincount(c, self.postings[at[x], g], len(batch) * units) for g, (x, c) in enumerate(zip(held, cells, strict=True))).reshape(-1, units) > self.worth
        left = [x[~made.reshape(-1)[c]] for x, c in zip(held, cells, strict=True)]
        pair = np.concatenate([at[x].astype(np.int64) * GROUPS + g for g, x in enumerate(left)])
        left = np.concatenate(left)
        order = np.argsort(left, kind="stable")
        left, pair = left[order], pair[order]
        ends = np.searchsorted(row[left], np.arange(len(batch) + 1))
        out = np.zeros((len(batch), self.width), np.float32)
        for unit in np.nonzero(made.any(axis=0))[0]:
            g, width = unit // len(TIERS), self.widths[unit]
            queries = np.nonzero(made[:, unit])[0]
            place = np.full(len(batch), -1)
            place[queries] = np.arange(len(queries))
            mine = held[g][cells[g] % units == unit]
            mine = mine[place[row[mine]] >= 0]
            dense = np.zeros((-(-len(queries) // QUERIES), QUERIES, width), np.float32)
            dense.reshape(-1, width)[place[row[mine]], self.column[at[mine], g]] = weight[mine]
            for b in np.nonzero(self.group == g)[0]:
                first, last, here = self.firsts[b], self.firsts[b + 1], unit * len(self.firsts) + b
                span = slice(self.dense_start[here], self.dense_start[here + 1])
                start = self.entry_start[self.dense[span]]
                n = self.entry_start[self.dense[span] + 1] - start
                places, weights = self._spread(start, n)
                part = np.zeros((last - first, width), np.float32)
                part[places - first, np.repeat(self.dense_column[span], n)] = weights
                out[queries, first:last] += np.concatenate([some @ part.T for some in dense])[: len(queries)]
        return out, [(pair[a:b], weight[left[a:b]]) for a, b in zip(ends, ends[1:], strict=False)]

    def nearest(self, queries: list[Vector], k: int, without: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query the k examples of largest cosine above 0 (ties: smaller number), best first; ``without`` is left
        out of it (-1: none)."""
        if not self.size:
            yield from ((np.zeros(0, np.int64), np.zeros(0)) for _ in queries)
            return
        batches = -(-len(queries) // BATCH)
        for i in range(batches):
            here = slice(len(queries) * i // batches, len(queries) * (i + 1) // batches)
            batch, gone = queries[here], np.array(without[here])
            out = np.where(gone >= 0, self.place[gone], -1)
            share, pairs = self._shares(batch)
            for a in range(0, len(batch), TOGETHER):
                b = a + TOGETHER
                yield from self._best(share[a:b], pairs[a:b], batch[a:b], k, out[a:b])

    def _sums(self, entries: np.ndarray, weight: np.ndarray) -> np.ndarray:
        if not len(entries):
            return np.zeros(self.width)
        # neighbours of one weight are one range
        new = np.concatenate([[True], (entries[1:] != entries[:-1] + 1) | (weight[1:] != weight[:-1])])
        first = np.nonzero(new)[0]
        start, last = self.entry_start[entries[first]], entries[np.append(first[1:], len(entries)) - 1]
        n = self.entry_start[last + 1] - start
        places, weights = self._spread(start, n)
        return np.bincount(places, weights * np.repeat(weight[first], n), self.width)

    def _best(self, share: np.ndarray, pairs: list[Vector], queries: list[Vector], k: int, out: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        size, blocks = len(queries), len(self.group)
        slack = PRECISION * (np.array([len(t) for t, _ in queries]) + 16)
        lists = [x for (t, _), (pair, _) in zip(queries, pairs, strict=True) for x in (self.term_entry[t], self.pair_entry[pair])]
        ends = [x for (t, _), (pair, _) in zip(queries, pairs, strict=True) for x in (self.term_entry[t + 1], self.pair_entry[pair + 1])]
        entries, n = _ranges(np.concatenate(lists), np.concatenate(ends))
        weight = np.repeat(np.concatenate([x for (_, w), (_, v) in zip(queries, pairs, strict=True) for x in (w.astype(np.float32), v)]), n)
        owner = np.repeat(np.arange(size), [len(t) + len(p) for (t, _), (p, _) in zip(queries, pairs, strict=True)])
        cell = np.repeat(owner * blocks, n) + self.entry_block[entries]
        cuts = np.searchsorted(cell, np.arange(size + 1) * blocks)  # as each query's cells follow those of the one before
        bound = np.maximum.reduceat(share, self.firsts[:-1], axis=1) + np.bincount(cell, self.entry_max[entries] * weight, size * blocks).reshape(size, blocks)
        wanted, least, score = np.zeros(bound.shape, bool), np.zeros(size), share.astype(float)
        np.put_along_axis(wanted, np.argsort(-bound, axis=1, kind="stable")[:, :FIRST_BLOCKS], True, axis=1)
        dropped = np.nonzero(out >= 0)[0]
        for wave in range(2):
            now = wanted.reshape(-1)[cell]
            for i in range(size):
                mine = slice(cuts[i], cuts[i + 1])
                some = now[mine]
                score[i] += self._sums(entries[mine][some], weight[mine][some])
            score[dropped, out[dropped]] = 0.0
            # of as many places as there are lanes, each of whose scores is a part of a cosine at least
            tops = score.reshape(size, LANES, -1).max(axis=1)
            if tops.shape[1] >= k:
                least = np.partition(tops, -k, axis=1)[:, -k]
            if not wave:
                wanted = (bound > 0) & (bound >= (least - slack)[:, None]) & ~wanted  # other blocks hold nothing better
        row, at = np.nonzero(score >= np.maximum(least - slack, np.finfo(float).tiny)[:, None])
        hits, cosine = self.example[at], np.round(score[row, at], DIGITS)
        order = np.lexsort((hits, -cosine, row))
        hits, cosine = hits[order], np.minimum(cosine[order], 1.0)
        for a, b in zip(*(lambda x: (x, x[1:]))(np.searchsorted(row, np.arange(size + 1))), strict=False):
            yield hits[a:b][:k], cosine[a:b][:k]

    def search(self, query: dict[int, float], k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        return next(self.nearest([(np.array(list(query), np.int32), np.array(list(query.values()), float))], k, [without]))


def unit_vectors(starts: np.ndarray, terms: np.ndarray, tf: np.ndarray, idf: np.ndarray) -> Frequencies:
    """Texts' frequencies as weighted vectors of length 1; terms without weight go."""
    weights = (1 + np.log(tf)) * idf[terms]
    kept, rows = weights > 0, np.repeat(np.arange(len(starts) - 1, dtype=np.int32), np.diff(starts))
    if not kept.all():
        rows, terms, weights = rows[kept], terms[kept], weights[kept]
        starts = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(starts) - 1))])
    weights /= np.sqrt(np.bincount(rows, weights * weights, len(starts) - 1))[rows]
    return starts, terms, weights


class Scorer:
    """Votes over the examples. It travels as their vectors; the index is built where it is used, and takes their place."""

    def __init__(self, idf: np.ndarray, examples: pa.Table, unit: tuple[float, float], prior: float):
        """idf: of each term, times its weight. examples: distinct vectors (terms, weights), numbers of clean and toxic rows
        (n0, n1), smallest doc_id. unit: the mass of one clean and one toxic row."""
        self.idf, self.prior, self.unit = idf, prior, unit
        self.clean, self.toxic = examples.column("n0").to_numpy() * unit[0], examples.column("n1").to_numpy() * unit[1]
        self.doc_ids = examples.column("doc_id").to_numpy()
        lengths = [c.value_lengths().to_numpy(zero_copy_only=False) for c in examples.column("terms").chunks]
        self.starts = np.concatenate([np.zeros(1, np.int64), *lengths]).cumsum()
        self.terms, self.weights = (np.concatenate([np.zeros(0, t), *(c.flatten().to_numpy() for c in examples.column(n).chunks)]).astype(t, copy=False) for n, t in (("terms", np.int32), ("weights", np.float32)))
        empty = np.diff(self.starts) == 0
        clean, toxic = self.clean[empty].sum(), self.toxic[empty].sum()
        self.blank = float((toxic + prior) / (clean + toxic + 1))  # the vote of examples without terms

    @cached_property
    def index(self) -> BlockMaxIndex:
        out = BlockMaxIndex(self.starts, self.terms, self.weights, len(self.idf))
        del self.terms, self.weights
        return out

    @cached_property
    def numbers(self) -> dict[int, int]:
        return {d: i for i, d in enumerate(self.doc_ids.tolist())}

    def vectors(self, found: Frequencies) -> list[Vector]:
        starts, terms, weights = unit_vectors(*found, self.idf)
        return [(terms[a:b], weights[a:b]) for a, b in zip(starts, starts[1:], strict=False)]

    def raw(self, vectors: list[Vector], own: list[tuple[int, int]] | None = None) -> Iterator[tuple[float, list[tuple[int, float]]]]:
        """Vote and evidence of each vector. ``own``: the example that each is, and the label of its row that has no vote."""
        own = own or [(-1, 0)] * len(vectors)
        less = [(self.unit[0] * (1 - label), self.unit[1] * label) for _, label in own]
        # its own class may stay, less its own row
        gone = [i if i >= 0 and self.clean[i] + self.toxic[i] <= sum(x) + 1e-9 else -1 for (i, _), x in zip(own, less, strict=True)]
        for (i, _), x, out, (best, cosine) in zip(own, less, gone, self.index.nearest(vectors, NEIGHBOURS, gone), strict=True):
            weight = 1 / (1.05 - cosine)
            clean, toxic = self.clean[best], self.toxic[best]
            if i >= 0 and out < 0:
                clean, toxic = clean - (best == i) * x[0], toxic - (best == i) * x[1]
            t, c = float(weight @ toxic), float(weight @ clean)
            yield (t + self.prior) / (t + c + 1), [(int(self.doc_ids[j]), round(float(y), 6)) for j, y in zip(best[:5], cosine, strict=False)]

    def left_out(self, doc_ids: list[int], vectors: list[Vector]) -> list[tuple[float, float, int]]:
        """(vote, mass, label) of the rows of these examples without their own vote."""
        at = [self.numbers[d] for d in doc_ids]
        own = [(i, label, v) for i, v in zip(at, vectors, strict=True) for label, mass in ((0, self.clean[i]), (1, self.toxic[i])) if mass > 0]
        votes = self.raw([v for *_, v in own], [x[:2] for x in own])
        return [(vote if len(v[0]) else self.blank, float((self.clean, self.toxic)[label][i]), label) for (i, label, v), (vote, _) in zip(own, votes, strict=True)]

    @staticmethod
    def fitted(votes: list[tuple[float, float, int]]) -> Knots:
        """Isotonic fit of labels on leave-one-out votes; levels rise, and scores between them are interpolated."""
        points = sorted((x, n, n * label) for x, n, label in votes)
        pools: list[list[float]] = []
        for x, n, y in points:
            pools.append([x * n, n, y])
            while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
                last = pools.pop()
                pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
        xs = np.array([0.0, *(p[0] / p[1] for p in pools), 1.0])
        ys = np.array([0.0, *(p[2] / p[1] for p in pools), 1.0])
        return xs, ys

    def score(self, texts: list[str | None], vocabulary: Vocabulary, knots: Knots) -> list[tuple[float, list[tuple[int, float]]]]:
        known: dict = {}
        distinct = list(dict.fromkeys(texts))
        for first in range(0, len(distinct), BATCH):
            some = distinct[first : first + BATCH]
            vectors = self.vectors(vocabulary.frequencies(some))
            for text, v, (raw, evidence) in zip(some, vectors, self.raw(vectors), strict=True):
                raw = raw if len(v[0]) else self.blank
                known[text] = min(1.0, max(0.0, float(np.interp(raw, *knots)))), evidence
        return [known[t] for t in texts]


def _significant(n1: Column, n0: Column, all1: int, all0: int) -> Column:
    """Log-likelihood ratio of a term with the label; 0 unless it is three times as likely under one label, and for terms of
    under three examples."""
    if not all1 or not all0:
        return F.lit(0.0)
    n, total = n1 + n0, all1 + all0
    p1, p0 = (n1 + 0.5) / (all1 + 1), (n0 + 0.5) / (all0 + 1)
    cells = ((n1, n * all1), (n0, n * all0), (all1 - n1, (total - n) * all1), (all0 - n0, (total - n) * all0))
    ratio = sum((F.when(seen > 0, seen * F.log(seen * total / expected)).otherwise(0.0) for seen, expected in cells), F.lit(0.0)) * 2
    return F.when((n < 3) | (F.greatest(p1, p0) < F.least(p1, p0) * 3), 0.0).otherwise(ratio)


def fit(docs: DataFrame, labels: DataFrame, scratch: Scratch, max_examples: int = MAX_EXAMPLES) -> tuple[Broadcast, Broadcast, Knots]:
    """Scorer, vocabulary and calibration. Examples: of each label the ``max_examples`` training rows of smallest hash. Without labelled rows every
    score is the prior, 0.5 x."""
    train = scratch.save(training_rows(labels), "labels")
    totals = dict(train.groupBy("toxic").count().collect())
    sample = None
    for label in (0, 1):
        part = train.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id").limit(max_examples)
        sample = part if sample is None else sample.union(part)
    mine = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # at most 2 x max_examples pairs of numbers
    texts = scratch.save(mine.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), "examples")

    def count_terms(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, hashes = hashed_terms(batch.column(1).to_pylist())
        order = np.lexsort((hashes, rows))
        rows, hashes = rows[order], hashes[order]
        new = np.concatenate([[True], (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])])[: len(rows)]
        found, term = np.unique(hashes[new], return_inverse=True)
        toxic = batch.column(0).to_numpy()[rows[new]] == 1
        return pa.record_batch([pa.array(found), *(pa.array(np.bincount(term[which], minlength=len(found))) for which in (~toxic, toxic))], names=["term", "n0", "n1"])

    held = dict(texts.groupBy("toxic").count().collect())
    all0, all1 = held.get(0, 0), held.get(1, 0)
    per_term = map_batches(texts.select("toxic", "text"), count_terms, "term bigint, n0 bigint, n1 bigint", most=SOME_BYTES).groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    # the terms of at most 2 x max_examples texts
    counted = per_term.select("term", (F.col("n0") + F.col("n1")).alias("n"), _significant(F.col("n1"), F.col("n0"), all1, all0).alias("ratio")).toArrow().sort_by("term")
    hashes, times, raised = counted.column("term").to_numpy(), counted.column("n").to_numpy(), 1 + counted.column("ratio").to_numpy() / UNIT_RATIO
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(hashes))

    def document_frequencies(batches):
        rows, seen = 0, np.zeros(len(shared.value.hashes), np.int64)
        for batch in batches:
            for part in parts(batch, SOME_BYTES):
                _, terms, _ = shared.value.frequencies(part.column(0).to_pylist())
                np.add.at(seen, terms, 1)
                rows += part.num_rows
        met = np.nonzero(seen)[0]
        yield pa.record_batch([pa.array(np.append(met, -1)), pa.array(np.append(seen[met], rows))], names=["term", "df"])
        release_memory()

    counted = mine.select("text").mapInArrow(document_frequencies, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(len(hashes) + 1)  # the last: documents
    df[counted.column("term").to_numpy()] = counted.column("df").to_numpy()
    idf = raised * np.log((df[-1] + 1) / (df[:-1] + 1))

    def vectors(batch: pa.RecordBatch) -> pa.RecordBatch:
        starts, *found = shared.value.frequencies(batch.column(2).to_pylist())
        lists = [pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(x)) for x in found]
        return pa.record_batch([batch.column(0), batch.column(1), *lists], names=["doc_id", "toxic", "terms", "tf"])

    grouped = map_batches(texts.select("doc_id", "toxic", "text"), vectors, "doc_id bigint, toxic int, terms array<int>, tf array<int>").groupBy("terms", "tf").agg(
        F.sum(1 - F.col("toxic")).alias("n0"), F.sum("toxic").alias("n1"), F.min("doc_id").alias("doc_id")
    )
    unit = (totals.get(0, 0) / all0 if all0 else 1.0, totals.get(1, 0) / all1 if all1 else 1.0)
    n = totals.get(0, 0) + totals.get(1, 0)
    weighing = docs.sparkSession.sparkContext.broadcast((idf, np.argsort(np.lexsort((times, idf > 0)))))  # and terms by rank: of weight, then frequent

    def weighted(batch: pa.RecordBatch) -> pa.RecordBatch:
        idf, rank = weighing.value
        lists, tf = batch.column(0), batch.column(1).flatten().to_numpy()
        starts, terms, weights = unit_vectors(np.append(0, lists.value_lengths().to_numpy(zero_copy_only=False).cumsum()), lists.flatten().to_numpy(), tf, idf)
        kind = [int(rank[terms[a:b]].max(initial=-1)) for a, b in zip(starts, starts[1:], strict=False)]
        ends = pa.array(starts, pa.int32())
        made = [pa.ListArray.from_arrays(ends, pa.array(terms, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(weights, pa.float32()))]
        return pa.record_batch([*batch.columns[2:], pa.array(kind, pa.int64()), *made], names=["n0", "n1", "doc_id", "kind", "terms", "weights"])

    made = scratch.save(map_batches(grouped.select("terms", "tf", "n0", "n1", "doc_id"), weighted, "n0 bigint, n1 bigint, doc_id bigint, kind bigint, terms array<int>, weights array<float>"), "vectors")
    # examples that share their most frequent telling term, and of one label, stand together, so that blocks differ
    spark = docs.sparkSession
    prior = totals.get(1, 0) / n if n else 0.5
    scorer = spark.sparkContext.broadcast(Scorer(idf, made.orderBy("kind", F.col("n1") > 0, "doc_id").toArrow(), unit, prior))  # at most 2 x max_examples
    release_memory()

    def left_out(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists, weights = batch.column(1), batch.column(2).flatten().to_numpy().astype(float)
        ends = np.append(0, lists.value_lengths().to_numpy(zero_copy_only=False).cumsum())
        terms = lists.flatten().to_numpy()
        got = scorer.value.left_out(batch.column(0).to_pylist(), [(terms[a:b], weights[a:b]) for a, b in zip(ends, ends[1:], strict=False)])
        return pa.record_batch([pa.array([x[i] for x in got], t) for i, t in enumerate((pa.float64(), pa.float64(), pa.int32()))], names=["vote", "mass", "label"])

    votes = map_batches(made.select("doc_id", "terms", "weights").repartition(spark.sparkContext.defaultParallelism * 2), left_out, "vote double, mass double, label int").collect()  # at most 2 x max_examples
    scratch.drop(made)
    scratch.drop(texts, train)
    return scorer, shared, Scorer.fitted([tuple(r) for r in votes])


def score(docs: DataFrame, labels: DataFrame, scratch: Scratch | None = None, **options) -> DataFrame:
    """All columns of ``docs`` but ``text`` are left; returns (doc_id, held_out, score, predicted, evidence) per row: evidence
    lists up to five nearest examples (doc_id, cosine). Null, empty and blank texts, and texts without any term of the
    examples, get the calibrated toxicity of examples without terms. Repeated rows are scored alike; a null doc_id is in
    no fold's held-out part; an empty table gives no rows."""
    scratch = scratch or Scratch(docs.sparkSession)
    scorer, vocabulary, knots = fit(docs, labels, scratch, **options)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = scorer.value.score(batch.column(2).to_pylist(), vocabulary.value, knots)
        evidence = pa.array([[{"doc_id": d, "cosine": c} for d, c in e] for _, e in got], pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64())])))
        return pa.record_batch([batch.column(0), batch.column(1), pa.array([s for s, _ in got], pa.float64()), pa.array([int(s >= 0.5) for s, _ in got], pa.int32()), evidence], names=["doc_id", "held_out", "score", "predicted", "evidence"])

    doc_id = F.col("doc_id").cast("bigint")
    return map_batches(docs.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), "text"), one, "doc_id bigint, held_out boolean, score double, predicted int, evidence array<struct<doc_id:bigint,cosine:double>>")


def drop_toxic(docs: DataFrame, labels: DataFrame, scratch: Scratch | None = None, **options) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns."""
    scorer, vocabulary, knots = fit(docs, labels, scratch or Scratch(docs.sparkSession), **options)

    def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
        return batch.filter(pa.array([s < 0.5 for s, _ in scorer.value.score(texts, vocabulary.value, knots)], pa.bool_()))

    return map_batches(docs, keep, docs.schema)
