"""Byte-level byte-pair encoding and decoding, by a vocabulary of ranks (``base64 rank`` lines).

A text is split by a pattern, and each piece looked up in two tiers:

1. Pieces that are tokens themselves: a minimal perfect hash sends every token of the vocabulary to a slot of
   its own (as many slots as tokens), and any other string to some slot, whose token is then compared with it
   byte by byte.  A whole batch of distinct pieces is looked up at once in numpy.
2. All others: a heap of adjacent pairs over linked bytes; the pair whose bytes have the lowest rank, leftmost
   of equals, is merged until none is a token.

The vocabulary's tables are made once on the driver and sent to the workers; their size is the vocabulary's.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import itertools
from array import array
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of text, and pieces of one text, that are worked on at once.
CHUNK_CHARS, CHUNK_PIECES = 1 << 20, 1 << 18
#: Encoded second-tier pieces that a worker remembers at most, of at most so many bytes each.
MEMO_PIECES, MEMO_BYTES = 200_000, 64
#: Beyond so many bytes a piece's links are kept in machine integers.
LONG_PIECE = 1 << 12
#: Tokens to a bucket of the hash, on average.
BUCKET = 4
#: Displacements tried at once.
TRIES = 64


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _words(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, count: int) -> np.ndarray:
    """Each string's bytes as `count` 64-bit words, filled up with zeros."""
    at = np.arange(8 * count)
    inside = at < sizes[:, None]
    return np.where(inside, data[np.where(inside, starts[:, None] + at, 0)], 0).astype(np.uint8).view("<u8").reshape(len(starts), count)


def _hashed(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    found = _mixed(sizes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    for column in words.T:
        found = _mixed((found + np.uint64(0x9E3779B97F4A7C15)) ^ column)
    return found


def _slots(hashes: np.ndarray, displacement: np.ndarray, n: int) -> np.ndarray:
    return (_mixed(hashes + _mixed(displacement.astype(np.uint64))) % np.uint64(n)).astype(np.int64)


class PerfectHash:
    """A minimal perfect hash of distinct byte strings, with the strings to compare with.

    Strings fall into buckets by hash; the largest buckets first, each takes the first displacement that sends
    its strings to free slots.  A bucket of one string takes a free slot outright, kept as a negative number.
    """

    def __init__(self, strings: list[bytes]):
        self.n = len(strings)
        self.sizes = np.array([len(s) for s in strings], np.int64)
        self.longest = int(self.sizes.max(initial=0))
        self.buckets = max(1, self.n // BUCKET)
        self.displacement = np.zeros(self.buckets, np.int64)
        self.slot_of = np.zeros(self.n, np.int64)
        self.string_at = np.zeros(self.n, np.int64)
        words = -(-self.longest // 8)
        data = np.frombuffer(b"".join(strings) or b"\0", np.uint8)
        self.words = _words(data, np.cumsum(self.sizes) - self.sizes, self.sizes, words)
        hashes = np.zeros(self.n, np.uint64)
        counts = -(-self.sizes // 8)
        for count in np.unique(counts):
            some = counts == count
            hashes[some] = _hashed(self.words[some, :count], self.sizes[some])
        if len(np.unique(hashes)) < self.n:
            raise ValueError("two strings of the vocabulary are alike, or share a 64-bit hash")
        self._place(hashes)

    def _place(self, hashes: np.ndarray) -> None:
        bucket = (hashes % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        counts = np.bincount(bucket, minlength=self.buckets)
        starts = np.cumsum(counts) - counts
        free = np.ones(self.n, bool)
        for b in np.argsort(-counts, kind="stable"):
            members = order[starts[b] : starts[b] + counts[b]]
            if len(members) < 2:
                break
            tried = 0
            while True:
                tries = np.arange(tried, tried + TRIES)
                slots = _slots(np.repeat(hashes[members][None], TRIES, 0), tries[:, None], self.n)
                ordered = np.sort(slots, axis=1)
                good = free[slots].all(axis=1) & (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
                if good.any():
                    break
                tried += TRIES
            first = int(np.argmax(good))
            self.displacement[b] = tried + first
            self.slot_of[members] = slots[first]
            free[slots[first]] = False
        single = np.flatnonzero(counts == 1)
        left = np.flatnonzero(free)
        self.displacement[single] = -left - 1
        self.slot_of[order[starts[single]]] = left
        self.string_at[self.slot_of] = np.arange(self.n)

    def find(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The number of each string among those of the table, -1 for others."""
        found = np.full(len(starts), -1, np.int64)
        counts = -(-sizes // 8)
        counts[(sizes > self.longest) | (sizes == 0)] = 0
        for count in np.unique(counts):
            if not count:
                continue
            some = np.flatnonzero(counts == count)
            words = _words(data, starts[some], sizes[some], count)
            hashes = _hashed(words, sizes[some])
            displacement = self.displacement[(hashes % np.uint64(self.buckets)).astype(np.int64)]
            slots = np.where(displacement < 0, -displacement - 1, _slots(hashes, np.maximum(displacement, 0), self.n))
            at = self.string_at[slots]
            same = (self.sizes[at] == sizes[some]) & (self.words[at, :count] == words).all(axis=1)
            found[some[same]] = at[same]
        return found


class Vocabulary:
    """A rank file's tokens, as both tiers and decoding need them."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            ranked = sorted((int(rank), base64.b64decode(token)) for token, rank in (line.split() for line in file if line.strip()))
        self.tokens = [token for _, token in ranked]
        self.ids = np.array([rank for rank, _ in ranked], np.int64)
        if missing := set(range(256)) - {t[0] for t in self.tokens if len(t) == 1}:
            raise ValueError(f"{path}: no token for the bytes {sorted(missing)}")
        self.hash = PerfectHash(self.tokens)

    @functools.cached_property
    def ranks(self) -> dict[bytes, int]:
        return dict(zip(self.tokens, self.ids.tolist()))

    @functools.cached_property
    def memo(self) -> dict[bytes, list[int]]:
        return {}

    @functools.cached_property
    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Every two tokens whose bytes together are a token, as left id << 32 | right id (ascending), and the id
        of that token; their number is at most the vocabulary's bytes."""
        ranks = self.ranks
        found = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    found[a << 32 | b] = rank
        keys = np.array(sorted(found), np.int64)
        return keys, np.array([found[k] for k in keys.tolist()], np.int64)

    @functools.cached_property
    def joined(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All tokens' bytes, where each id starts, and its size (-1 for an id that there isn't)."""
        sizes = np.full(int(self.ids.max()) + 1, -1, np.int64)
        starts = np.zeros_like(sizes)
        sizes[self.ids] = self.hash.sizes
        starts[self.ids] = np.cumsum(self.hash.sizes) - self.hash.sizes
        return np.frombuffer(b"".join(self.tokens), np.uint8), starts, sizes

    def __getstate__(self) -> dict:
        return {"tokens": self.tokens, "ids": self.ids, "hash": self.hash}

    def encoded(self, piece: bytes) -> list[int]:
        """The ids of a piece that isn't a token; short ones are remembered."""
        ids = self.memo.get(piece)
        if ids is None:
            ids = merged(piece, self.ranks, self.hash.longest)
            if len(piece) <= MEMO_BYTES:
                if len(self.memo) >= MEMO_PIECES:
                    self.memo.clear()
                self.memo[piece] = ids
        return ids


def merged(piece: bytes, ranks: dict[bytes, int], longest: int) -> list[int]:
    """Token ids of a piece, by a heap of adjacent pairs over linked bytes.

    Symbol i goes from byte i up to the next symbol at after[i]; rank_at[i] is the rank of the pair that it
    begins, -1 if none.  An entry of the heap whose pair has changed since is passed over.
    """
    n, get = len(piece), ranks.get
    if not n:
        return []
    rank_at = [get(piece[i : i + 2], -1) for i in range(n - 1)]
    rank_at.append(-1)
    heap = [rank << 40 | i for i, rank in enumerate(rank_at) if rank >= 0]
    heapq.heapify(heap)
    after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
    if n > LONG_PIECE:
        rank_at, after, before = array("q", rank_at), array("q", after), array("q", before)
    while heap:
        top = heappop(heap)
        i = top & 0xFFFFFFFFFF
        if rank_at[i] != top >> 40:
            continue
        j = after[i]
        after[i] = k = after[j]
        rank_at[j] = -1
        if k < n:
            before[k] = i
            end = after[k]
            rank_at[i] = rank = get(piece[i:end], -1) if end - i <= longest else -1
            if rank >= 0:
                heappush(heap, rank << 40 | i)
        else:
            rank_at[i] = -1
        i = before[i]
        if i >= 0:
            rank_at[i] = rank = get(piece[i:k], -1) if k - i <= longest else -1
            if rank >= 0:
                heappush(heap, rank << 40 | i)
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return ids


def merged_all(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of many pieces at once (piece k: data[starts[k] : starts[k] + sizes[k]]), and how many each
    has, as `merged` gives them: each round merges, in every piece that still can, its pair of lowest rank,
    leftmost of equals.  Symbols of all pieces stand in one row, in order, as token ids; two of them make a token
    if the vocabulary's pairs say so.  A piece without such a pair is done."""
    keys, joined = vocabulary.pairs
    single = np.zeros(256, np.int64)
    single[[t[0] for t in vocabulary.tokens if len(t) == 1]] = [r for t, r in zip(vocabulary.tokens, vocabulary.ids.tolist()) if len(t) == 1]
    piece = np.repeat(np.arange(len(starts)), sizes)
    symbol = single[_spread(data, starts, sizes)]
    active = np.ones(len(starts), bool)
    while len(keys):
        left = np.flatnonzero((piece[:-1] == piece[1:]) & active[piece[:-1]])
        if not len(left):
            break
        key = symbol[left] << 32 | symbol[left + 1]
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        some = keys[at] == key
        active[piece[left]] = False
        left, rank = left[some], joined[at[some]]
        if not len(left):
            break
        owner = piece[left]
        firsts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        least = np.repeat(np.minimum.reduceat(rank, firsts), np.diff(np.append(firsts, len(rank))))
        low = np.flatnonzero(rank == least)
        low = low[np.concatenate([[True], owner[low][1:] != owner[low][:-1]])]
        first = left[low]
        active[owner[low]] = True
        symbol[first] = rank[low]
        keep = np.ones(len(piece), bool)
        keep[first + 1] = False
        piece, symbol = piece[keep], symbol[keep]
    return symbol, np.bincount(piece, minlength=len(starts))


def _spread(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of `values` that begin at `starts`, one after the other."""
    ends = np.cumsum(sizes)
    if not len(ends) or not ends[-1]:
        return values[:0]
    return values[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1])]


def ids_of(pieces: list[str], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all pieces, and how many each has."""
    if not pieces:
        return np.empty(0, np.int32), np.empty(0, np.int64)
    coded = pa.array(pieces, pa.large_string()).dictionary_encode()
    distinct = coded.dictionary
    offsets = np.frombuffer(distinct.buffers()[1], np.int64)[: len(distinct) + 1]
    data = np.frombuffer(distinct.buffers()[2], np.uint8)
    starts, sizes = offsets[:-1], np.diff(offsets)
    at = vocabulary.hash.find(data, starts, sizes)
    counts = np.ones(len(at), np.int64)
    missed = np.flatnonzero(at < 0)
    short, missed = missed[sizes[missed] <= MEMO_BYTES], missed[sizes[missed] > MEMO_BYTES]
    merged_ids, counts[short] = merged_all(data, starts[short], sizes[short], vocabulary)
    others = [vocabulary.encoded(data[starts[n] : starts[n] + sizes[n]].tobytes()) for n in missed]
    counts[missed] = [len(ids) for ids in others]
    firsts = np.cumsum(counts) - counts
    flat = np.empty(int(counts.sum()), np.int32)
    hits = at >= 0
    flat[firsts[hits]] = vocabulary.ids[at[hits]]
    flat[_spread(np.arange(len(flat)), firsts[short], counts[short])] = merged_ids
    if len(missed):
        flat[_spread(np.arange(len(flat)), firsts[missed], counts[missed])] = np.fromiter(itertools.chain.from_iterable(others), np.int32, int(counts[missed].sum()))
    order = coded.indices.to_numpy()
    return _spread(flat, firsts[order], counts[order]), counts[order]


def encoded_texts(texts: list[str | None], vocabulary: Vocabulary, pattern: regex.Pattern) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, and how many each has; a bounded number of pieces is looked up at a time."""
    parts: list[np.ndarray] = []
    totals = np.zeros(len(texts), np.int64)
    pieces: list[str] = []
    owners: list[tuple[int, int]] = []  # (text, pieces)

    def flush() -> None:
        ids, counts = ids_of(pieces, vocabulary)
        parts.append(ids)
        ends = np.concatenate([[0], np.cumsum(counts)])
        at = 0
        for n, size in owners:
            totals[n] += ends[at + size] - ends[at]
            at += size
        pieces.clear()
        owners.clear()

    for n, text in enumerate(texts):
        if not text:
            continue
        if len(text) <= CHUNK_PIECES:
            found = pattern.findall(text)
            pieces += found
            owners.append((n, len(found)))
            if len(pieces) >= CHUNK_PIECES:
                flush()
            continue
        count = 0
        for match in pattern.finditer(text):  # a long text, some pieces at a time
            pieces.append(match.group())
            count += 1
            if len(pieces) >= CHUNK_PIECES:
                owners.append((n, count))
                flush()
                count = 0
        owners.append((n, count))
    flush()
    return np.concatenate(parts), totals


def decoded_bytes(ids: np.ndarray, counts: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The bytes that runs of ids stand for, and how many each run has."""
    data, starts, sizes = vocabulary.joined
    if len(ids) and (ids.min() < 0 or ids.max() >= len(sizes) or (sizes[ids] < 0).any()):
        raise ValueError("an id isn't in the vocabulary")
    ends = np.concatenate([[0], np.cumsum(sizes[ids])])
    runs = np.concatenate([[0], np.cumsum(counts)])
    some = [ids[k : k + CHUNK_PIECES] for k in range(0, len(ids), CHUNK_PIECES)] or [ids]
    return np.concatenate([_spread(data, starts[part], sizes[part]) for part in some]), np.diff(ends[runs])


@functools.cache
def vocabulary_at(path: str) -> Vocabulary:
    return Vocabulary(path)


def _runs(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Rows in runs of some CHUNK_CHARS bytes."""
    size = batch.column(column).nbytes / max(batch.num_rows, 1)
    step = max(1, int(CHUNK_CHARS / max(size, 1)))
    for start in range(0, batch.num_rows, step):
        yield batch.slice(start, step)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and ids (an array) of every text, in the vocabulary at `path`, split by `pattern`.

    No special tokens: their strings are ordinary text.  A null or empty text has no ids; null ids and repeated
    rows stay as they are; other columns are left out; no rows give no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary_at(path))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = regex.compile(pattern)
        for batch in batches:
            for part in _runs(batch, "text"):
                ids, counts = encoded_texts(part.column("text").to_pylist(), sent.value, pieces)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts), lists], ["doc_id", "n_tokens", "ids"])

    return _texts(docs).mapInArrow(encoded, "doc_id long, n_tokens long, ids array<int>")


def decode(rows: DataFrame, path: str) -> DataFrame:
    """doc_id and the bytes that ids stand for; null ids are no bytes, ids that aren't in the vocabulary an error."""
    sent = rows.sparkSession.sparkContext.broadcast(vocabulary_at(path))

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _runs(batch, "ids"):
                lists = part.column("ids")
                counts = np.array([n or 0 for n in lists.value_lengths().to_pylist()], np.int64)
                data, sizes = decoded_bytes(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), counts, sent.value)
                ends = np.concatenate([[0], np.cumsum(sizes)])
                texts = pa.array([data[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), texts], ["doc_id", "decoded"])

    return rows.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(decoded, "doc_id long, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit integers) and decoded_sha256 (of
    the bytes that they are decoded to); both steps in one pass.  Cases as in `encode`."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary_at(path))

    def tried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = regex.compile(pattern)
        for batch in batches:
            for part in _runs(batch, "text"):
                ids, counts = encoded_texts(part.column("text").to_pylist(), sent.value, pieces)
                data, sizes = decoded_bytes(ids, counts, sent.value)
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array(counts), _digests(ids.astype("<u4"), counts), _digests(data, sizes),
                ], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _texts(docs).mapInArrow(tried, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _digests(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(counts)])
    view = memoryview(np.ascontiguousarray(values)).cast("B") if len(values) else memoryview(b"")
    size = values.itemsize
    return pa.array([hashlib.sha256(view[a * size : b * size]).hexdigest() for a, b in zip(ends, ends[1:])], pa.string())
