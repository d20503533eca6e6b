"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over SPAN tokens: the hash of a place takes the tokens where the mask has 1 and
ignores the others, so two passages that differ only in ignored places still share it.  Documents' places
are looked up among the benchmark's; a hit fixes an alignment of a document with an item, and around
the hit the alignment is verified token by token.  A document is contaminated where an aligned window of
WINDOW tokens has at most MISSES substitutions.  An item shorter than the window must match as a whole, with
as many substitutions as its share of the window allows; its masks reach over all its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactum.llm.frames import ids, restored, text_chunks
from pactum.llm.words import hash_words, mixed, owners

# Fixed values of the operator: what counts as an overlap, and masks that between them hit every
# window of 16 tokens with up to 2 substitutions (a test tries all placements).
WINDOW, MISSES = 16, 2
MASKS = ("1111110011", "111010101011", "1100110011011")
#: Masks of an item shorter than the window: each ignores every SPLIT-th word, so one of them ignores any
#: single substitution.  Where none is allowed, one mask takes all words.
SPLIT = 4
#: Benchmark bytes that are sent to every executor; a larger benchmark is searched in parts of this size.
PART_BYTES = 16 << 20
_U = np.uint64


def misses(size: int) -> int:
    """Substitutions that a match of so many words may have."""
    return MISSES * size // WINDOW


def short_masks(size: int) -> list[str]:
    """Masks over all words of an item shorter than WINDOW."""
    if not misses(size):
        return ["1" * size]
    return ["".join("0" if k % SPLIT == drop else "1" for k in range(size)) for drop in range(SPLIT)]


def seeds(words: np.ndarray, owner: np.ndarray, mask: str, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first word) of every place whose words all belong to one text."""
    m = len(words) - len(mask) + 1
    if m <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = np.full(m, salt, np.uint64)
    for k, bit in enumerate(mask):
        if bit == "1":
            h *= _U(0x9E3779B97F4A7C15)
            h += words[k : k + m]
    places = np.flatnonzero(owner[:m] == owner[len(mask) - 1 :])
    return mixed(h[places]), places


def _runs(group: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(group, first place, step, places) of runs of evenly spaced places; `place` ascends within a group.  Text that
    repeats itself has few runs however long it is; elsewhere a place is a run of one."""
    n = len(place)
    new = np.ones(n, bool)
    if n > 1:
        step = np.diff(place)
        same = group[1:] == group[:-1]
        new[1:] = ~same
        new[2:] |= same[:-1] & (step[1:] != step[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, n))
    steps = np.where(count > 1, place[np.minimum(first + 1, max(n - 1, 0))] - place[first], 0) if n else first
    return group[first], place[first], steps, count


def _shifts(p: np.ndarray, sp: np.ndarray, cp: np.ndarray, q: np.ndarray, sq: np.ndarray, cq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pair, shift) for pairs of runs, (first, step, count) each: all differences of a place of one and a place of
    the other.  Runs of one step give as many as both have places together, not as their product."""
    pair = np.arange(len(p))
    uneven = (sp != sq) & (cp > 1) & (cq > 1)
    if uneven.any():  # the shorter run is taken place by place
        odd = np.flatnonzero(uneven)
        few = np.minimum(cp, cq)[odd]
        pair = np.concatenate([np.flatnonzero(~uneven), np.repeat(odd, few)])
        nth = np.arange(few.sum()) - np.repeat(np.cumsum(few) - few, few)
        nth = np.concatenate([np.zeros(len(pair) - len(nth), np.int64), nth])
        cut_p = uneven[pair] & (cp[pair] <= cq[pair])
        cut_q = uneven[pair] & ~cut_p
        p, q = p[pair] + nth * np.where(cut_p, sp[pair], 0), q[pair] + nth * np.where(cut_q, sq[pair], 0)
        cp, cq = np.where(cut_p, 1, cp[pair]), np.where(cut_q, 1, cq[pair])
        sp, sq = sp[pair], sq[pair]
    step, count = np.where(cp > 1, sp, sq), cp + cq - 1
    low = p - q - np.where(cq > 1, sq, 0) * (cq - 1)
    owner = np.repeat(np.arange(len(low)), count)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    return pair[owner], low[owner] + nth * step[owner]


class Benchmark:
    """Hashed words and seeds of one part of the benchmark."""

    def __init__(self, items: list[tuple[int, str]]):
        texts = [(text or "").encode() for _, text in items]
        offsets = np.cumsum([0, *map(len, texts)])
        self.ids = np.array([i for i, _ in items], np.int64)
        self.words, self.firsts = hash_words(np.frombuffer(b"".join(texts), np.uint8), offsets)
        owner = owners(self.firsts)
        self.owner = owner
        sizes = np.diff(self.firsts)
        self.seeds, self.short = [], {}
        for salt, mask in enumerate(MASKS):
            self.seeds.append(_index(*seeds(self.words, owner, mask, salt), owner, mask, salt, lambda at: sizes[owner[at]] >= WINDOW))
        for size in np.unique(sizes[(sizes > 0) & (sizes < WINDOW)]).tolist():
            self.short[size] = [
                _index(*seeds(self.words, owner, mask, salt), owner, mask, salt, lambda at: sizes[owner[at]] == size)
                for salt, mask in enumerate(short_masks(size), len(MASKS))]

    def alignments(self, words: np.ndarray, owner: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(text, item, shift) of every hit, each once: word w of the benchmark stands beside word w + shift."""
        found = []
        for seed in self.seeds:
            places, k = _met(seed, words, owner)
            if not len(places):
                continue
            values = len(seed[2])
            order = np.lexsort((places, k, owner[places]))
            group, p, sp, cp = _runs((owner[places] * values + k)[order], places[order])
            a, b = _expanded(seed, np.arange(len(group)), group % values)
            q, sq, cq = (column[b] for column in seed[7])
            pair, shift = _shifts(p[a], sp[a], cp[a], q, sq, cq)
            found.append(np.stack([owner[p[a]][pair], self.owner[q][pair], shift]))
        if found:
            rows = np.concatenate(found, axis=1)
            rows = rows[:, np.lexsort(rows[::-1])]
            new = np.ones(rows.shape[1], bool)
            new[1:] = (rows[:, 1:] != rows[:, :-1]).any(axis=0)
            yield from zip(*rows[:, new].tolist())

    def overlaps(self, words: np.ndarray, firsts: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(text, item id, first word, words, matches) of every verified alignment, its windows joined."""
        owner = owners(firsts)
        found = self.short_overlaps(words, firsts, owner)
        for text, item, shift in self.alignments(words, owner):
            # the part of the alignment that lies in both
            lo = max(self.firsts[item], firsts[text] - shift)
            hi = min(self.firsts[item + 1], firsts[text + 1] - shift)
            same = self.words[lo:hi] == words[lo + shift : hi + shift]
            if hi - lo < WINDOW:
                continue
            total = np.concatenate([[0], np.cumsum(same)])
            good = np.flatnonzero(total[WINDOW:] - total[:-WINDOW] >= WINDOW - MISSES)
            if len(good):
                a, b = int(good[0]), int(good[-1]) + WINDOW
                found.append((int(text), int(self.ids[item]), int(lo + shift - firsts[text]) + a, b - a, int(total[b] - total[a])))
        return found

    def short_overlaps(self, words: np.ndarray, firsts: np.ndarray, owner: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """As `overlaps`, of items shorter than WINDOW: for each text and item the best alignment."""
        found = []
        for size, of_size in self.short.items():
            left, right = [], []
            for seed in of_size:
                places, k = _met(seed, words, owner)
                if not misses(size):  # all hits match alike: a text's first is its best
                    order = np.lexsort((places, k, owner[places]))
                    places, k = places[order], k[order]
                    new = np.ones(len(k), bool)
                    new[1:] = (k[1:] != k[:-1]) | (owner[places[1:]] != owner[places[:-1]])
                    places, k = places[new], k[new]
                a, b = _expanded(seed, places, k)
                b = seed[5][b]  # such an item has one place, so a run is a place
                same = sum((words[a + j] == self.words[b + j] for j in range(size)), np.zeros(len(a), np.int64))
                good = same >= size - misses(size)
                left.append(np.stack([a[good], same[good]]))
                right.append(b[good])
            (a, same), b = np.concatenate(left, axis=1), np.concatenate(right)
            text, item = owner[a], self.owner[b]
            order = np.lexsort((a, -same, item, text))
            a, same, text, item = a[order], same[order], text[order], item[order]
            new = np.ones(len(a), bool)
            new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1])
            a, same, text, item = a[new], same[new], text[new], item[new]
            found += zip(text.tolist(), self.ids[item].tolist(), (a - firsts[text]).tolist(), [size] * len(a), same.tolist())
        return found


def _index(h: np.ndarray, at: np.ndarray, owner: np.ndarray, mask: str, salt: int, wanted) -> tuple:
    """The wanted places of the benchmark by hash, as runs inside one item."""
    keep = wanted(at)
    h, at = h[keep], at[keep]
    order = np.argsort(h, kind="stable")
    h, at = h[order], at[order]
    values, k = np.unique(h, return_inverse=True)
    _, q, step, count = _runs(k * (int(owner[-1]) + 1 if len(owner) else 1) + owner[at], at)
    first = np.searchsorted(h[np.cumsum(count) - count] if len(h) else h, values)
    return mask, salt, values, first, np.append(first[1:], len(q)), q, _filter(values), (q, step, count)


def _met(seed: tuple, words: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places whose hash the benchmark has, and its number among the seed's values."""
    mask, salt, values, maybe = seed[0], seed[1], seed[2], seed[6]
    if not len(values):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    h, places = seeds(words, owner, mask, salt)
    likely = maybe[(h >> _U(44)).astype(np.int64)]
    h, places = h[likely], places[likely]
    k = np.minimum(np.searchsorted(values, h), len(values) - 1)
    same = values[k] == h
    return places[same], k[same]


def _expanded(seed: tuple, rows: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row with the numbers of all runs of the benchmark that have its value."""
    first, last = seed[3], seed[4]
    if not len(k):
        return rows, k
    count = last[k] - first[k]
    return np.repeat(rows, count), np.repeat(first[k] - np.cumsum(count) + count, count) + np.arange(count.sum())


def _filter(values: np.ndarray) -> np.ndarray:
    """A table of 2**20 bits by the top bits of a hash: nearly all places are ruled out by one look-up."""
    maybe = np.zeros(1 << 20, bool)
    maybe[(values >> _U(44)).astype(np.int64)] = True
    return maybe


OVERLAPS = "doc_id long, item_id long, start long, n_words long, n_matches long"


def benchmark_overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start, n_words, n_matches: for each document and item with a verified overlap, the
    best alignment (most matching words, then the first).

    The benchmark is read in parts of at most PART_BYTES (one item, if it is longer) and each part is sent
    to the executors: what is broadcast never grows beyond that, a larger benchmark takes more passes.
    Null and empty texts on either side match nothing; an item of fewer words than allow a substitution must
    stand in the text as it is, even a single word; repeated items and rows are matched each; null ids are
    kept.  Other columns are left out.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = None
    for items in _parts(benchmark):
        sent = spark.sparkContext.broadcast(Benchmark(items))

        def matched(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                names, rows = ids(batch), []
                for first, _, data, offsets in text_chunks(batch):
                    words, firsts = hash_words(data, offsets)
                    rows += [(names[first + text], *more) for text, *more in sent.value.overlaps(words, firsts)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "item_id", "start", "n_words", "n_matches"])

        part = texts.mapInArrow(matched, OVERLAPS)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], OVERLAPS)
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_matches", (-F.col("start")).alias("back"), "n_words")).alias("b"))
    return best.select(restored(), restored("item_id"), (-F.col("b.back")).alias("start"), "b.n_words", "b.n_matches")


def _parts(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's items in parts of bounded size, one part in the driver at a time."""
    part, size = [], 0
    items = benchmark.select(F.coalesce(F.col("item_id").cast("long"), F.lit(-(1 << 63))), F.col("text").cast("string"))
    for item, text in items.where(F.col("text").isNotNull()).toLocalIterator():
        if part and size + len(text) > PART_BYTES:
            yield part
            part, size = [], 0
        part.append((item, text))
        size += len(text)
    if part:
        yield part
