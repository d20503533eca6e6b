"""Removal of byte strings that occur earlier in the corpus, by suffix order.

Every window of LENGTH bytes has an anchor: its piece of GRAM bytes with the smallest hash, the first of
equals.  Equal windows have equal anchors at the same place, so windows need to be compared only among
those of one anchor.  Neighbouring windows share an anchor: such a run is a record of the anchor's hash and
a hash of all bytes the run covers.

1. Records are shuffled by anchor.  Those alike in all bytes: all but the first repeat.  An anchor met
   once ends there.
2. Where an anchor has different surroundings, these (the runs' bytes) are shuffled by anchor and brought
   into suffix order; windows that are equal stand together, and all but the first repeat.
3. Repeated windows go to their documents, which cut the covered bytes.

A document is a different (doc_id, text), told by a 64-bit hash of both; its id only says which of two equal
windows is earlier.

Texts are shuffled only for documents that lose bytes.  Which anchors and documents go on is told to the
tasks by bit tables of a fixed size; a table too full lets more through, which changes nothing but the work.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pactum.llm.bit_tables import bit_table, hit
from pactum.llm.frames import documents, ids, text_chunks, written
from pactum.llm.words import _BYTE, _STEP, mixed

LENGTH, GRAM = 100, 32
#: Anchors that one window may have: its pieces' first bytes.
SPAN = LENGTH - GRAM + 1
#: Bytes brought into suffix order at once, and surroundings of one anchor at most; the windows of an
#: anchor with more are told apart by 128-bit digests, in a shuffle of their own.
ORDER_BYTES, ORDER_ROWS = 1 << 16, 4096
_U = np.uint64


def _doubled(x: np.ndarray, size: int, step: np.uint64) -> tuple[np.ndarray, np.uint64]:
    return x[:-size] * step + x[size:], _U(int(step) * int(step) & 0xFFFFFFFFFFFFFFFF)


def anchors(data: np.ndarray, offsets: np.ndarray):
    """Runs of windows with one anchor: (anchor hash, hash of the run's bytes, text, first window's start
    in the text, windows, bytes from there to the anchor)."""
    empty = [np.empty(0, np.int64)] * 6
    n = len(data)
    if n < LENGTH:
        return empty
    h, step = _BYTE[data], _STEP
    for size in (1, 2, 4, 8, 16):
        h, step = _doubled(h, size, step)
    h64 = h[:-32] * step + h[32:]
    # the smallest hash among SPAN neighbours, and its place: low bits hold the place
    bits = _U(max(1, int(n).bit_length()))
    low = (_U(1) << bits) - _U(1)
    best = (mixed(h) & ~low) | np.arange(len(h), dtype=np.uint64)
    size = 1
    while size * 2 <= SPAN:
        best = np.minimum(best[:-size], best[size:])
        size *= 2
    if size < SPAN:
        best = np.minimum(best[: len(best) - (SPAN - size)], best[SPAN - size :])
    place = (best & low).astype(np.int64)  # of each window's anchor
    text = np.searchsorted(offsets, np.arange(n - LENGTH + 1), "right") - 1
    whole = np.arange(n - LENGTH + 1) + LENGTH <= offsets[text + 1]
    new = whole.copy()
    new[1:] &= (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    begin = np.flatnonzero(new)
    if not len(begin):
        return empty
    # a run ends where the next begins or windows stop being whole
    stop = np.flatnonzero(whole & ~np.append(whole[1:] & ~new[1:], False)) + 1
    count = stop - begin
    a, text = place[begin], text[begin]
    end = begin + count - 1 + LENGTH
    around = mixed(h64[begin] ^ mixed(h64[np.minimum(begin + 64, end - 64)] ^ mixed(h64[end - 64] + count.astype(np.uint64))) ^ mixed((a - begin).astype(np.uint64)))
    return mixed(h[a] + _U(7)), around, text, begin - offsets[text], count, a - begin


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs as records.  Of equal ones that a batch holds, the first speaks for all; the others are
    settled (windows that an earlier one equals) and only pass through, each under a key of its own."""
    for batch in batches:
        doc, row, parts = ids(batch), ids(batch, "row"), []
        for first, _, data, offsets in text_chunks(batch):
            h, around, text, start, count, off = anchors(data, offsets)
            if len(h):
                parts.append((h.view(np.int64), around.view(np.int64), doc[text + first], row[text + first], start << 16 | count << 8 | off))
        if not parts:
            continue
        h, around, d, r, at = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((at, d, around, h))
        h, around, d, r, at = h[order], around[order], d[order], r[order], at[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (around[1:] != around[:-1])
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        again = (d != d[first]) | (at != at[first])
        own = mixed(d.view(np.uint64) * _STEP + at.view(np.uint64)).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.where(again, own, h)), pa.array(around), pa.array(d), pa.array(r), pa.array(np.where(again, ~at, at))], ["h", "around", "doc_id", "row", "at"])


def _surroundings(table):
    """Anchor, hash of the surroundings, place and bytes of the runs whose anchor is in the table.  Of runs
    alike in all bytes those at the first place stay: one, but for documents of one id that have it at the
    same place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, rows, met = ids(batch), ids(batch, "row"), {}
            for first, _, data, offsets in text_chunks(batch):
                h, around, text, start, count, off = anchors(data, offsets)
                if not len(h):
                    continue
                some = np.flatnonzero(hit(table.value, h))
                raw = data.tobytes()
                for k in some.tolist():
                    key = int(h[k]), int(around[k])
                    place = int(doc[text[k] + first]), int(start[k] << 16 | count[k] << 8 | off[k])
                    if key not in met or place < met[key][0]:
                        b = int(offsets[text[k]] + start[k])
                        met[key] = place, raw[b : b + int(count[k]) - 1 + LENGTH], {int(rows[text[k] + first])}
                    elif place == met[key][0]:
                        met[key][2].add(int(rows[text[k] + first]))
            if met:
                flat = [(*key, d, row, at, b) for key, ((d, at), b, same) in met.items() for row in same]
                h, around, *rest = zip(*flat)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.array(h, np.uint64).view(np.int64)), pa.array(np.array(around, np.uint64).view(np.int64)),
                    *[pa.array(x, pa.int64()) for x in rest[:3]], pa.array(rest[3], pa.binary()),
                ], ["h", "around", "doc_id", "row", "at", "bytes"])

    return run


def repeated_windows(rows: list[tuple[int, int, int, bytes]]) -> list[tuple[int, int]]:
    """(row, start) of the windows of some runs (doc, row, at, bytes) that an earlier window among them equals."""
    texts = [b for *_, b in rows]
    base = np.cumsum([0, *(len(b) + 1 for b in texts)])
    counts = np.array([at >> 8 & 255 for *_, at, _ in rows], np.int64)
    starts = np.array([at >> 16 for *_, at, _ in rows], np.int64)
    if counts.sum() < 2:
        return []
    row = np.repeat(np.arange(len(rows)), counts)
    off = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    # every window's bytes as words, filled up with zeros; sorted by them, equal windows stand together
    words = -(-LENGTH // 8)
    data = np.frombuffer(b"\0".join(texts) + bytes(8 * words), np.uint8)
    window = np.lib.stride_tricks.sliding_window_view(data, 8 * words)[base[row] + off]
    window[:, LENGTH:] = 0
    window = window.view("<u8")
    order = np.lexsort(window.T[::-1])
    window, row, off = window[order], row[order], off[order]
    same = np.zeros(len(order), bool)
    same[1:] = (window[1:] == window[:-1]).all(axis=1)
    group = np.cumsum(~same)
    doc = np.array([d for d, *_ in rows], np.int64)[row]
    key = np.array([r for _, r, *_ in rows], np.int64)[row]
    start = starts[row] + off
    sort = np.lexsort((start, doc, group))
    group, doc, key, start = group[sort], doc[sort], key[sort], start[sort]
    new = np.ones(len(sort), bool)
    new[1:] = group[1:] != group[:-1]
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    later = (doc != doc[first]) | (start != start[first])  # documents of one id: neither place is earlier
    return list(zip(key[later].tolist(), start[later].tolist()))


def _ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated windows of anchors whose rows come together; digests of windows of an anchor with too many."""
    names = ["doc_id", "row", "start", "d1", "d2"]

    def digests(group):
        cut = [(d, r, (at >> 16) + k, hashlib.blake2b(b[k : k + LENGTH], digest_size=16).digest()) for d, r, at, b in group for k in range(at >> 8 & 255)]
        d = np.frombuffer(b"".join(x for *_, x in cut), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([*[pa.array([x[k] for x in cut], pa.int64()) for k in range(3)], pa.array(d[:, 0]), pa.array(d[:, 1])], names)

    def found(rows):
        windows = repeated_windows(rows)
        none = pa.nulls(len(windows), pa.int64())
        return pa.RecordBatch.from_arrays([none, pa.array([w[0] for w in windows], pa.int64()), pa.array([w[1] for w in windows], pa.int64()), none, none], names)

    ready: list = []
    group: list = []
    key = last = place = None
    size, many = 0, False
    for batch in batches:
        for h, around, doc, row, at, b in zip(*(c.to_pylist() for c in batch.columns)):
            if h != key:
                if many and group:
                    yield digests(group)
                elif not many and len(group) > 1:
                    ready += group
                    size += sum(len(x[-1]) for x in group)
                if size >= ORDER_BYTES:
                    yield found(ready)
                    ready, size = [], 0
                group, key, last, many = [], h, None, False
            if around == last and (place[:2] != (doc, at) or place[2] == row):
                continue  # alike in all bytes and later: settled before; or an equal row
            last, place = around, (doc, at, row)
            group.append((doc, row, at, b))
            if len(group) > ORDER_ROWS:
                yield digests(group)
                group, many = [], True
    if many and group:
        yield digests(group)
    elif not many and len(group) > 1:
        ready += group
    if ready:
        yield found(ready)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The kept bytes' digest of texts whose repeated windows are known."""
    for batch in batches:
        gone, runs, kept = [], [], []
        columns = (batch.column(c).to_pylist() for c in ("text", "windows", "whole"))
        for text, found, whole in zip(*columns):
            if not found:
                gone.append(0)
                runs.append(0)
                kept.append(whole)
                continue
            data = np.frombuffer((text or "").encode(), np.uint8)
            edge = np.zeros(len(data) + 1, np.int32)
            w = np.array([(x["start"], x["start"] + x["count"] - 1 + LENGTH) for x in found], np.int64).reshape(-1, 2)
            np.add.at(edge, w[:, 0], 1)
            np.add.at(edge, w[:, 1], -1)
            covered = np.cumsum(edge)[:-1] > 0
            gone.append(int(covered.sum()))
            runs.append(int((covered & ~np.append(False, covered[:-1])).sum()))
            kept.append(hashlib.sha256(data[~covered].tobytes()).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("n_bytes"), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept)],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _held(table):
    """Rows of documents; the text stays with those in the table only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask = pa.array(hit(table.value, ids(batch, "row").view(np.uint64)))
            text = pc.if_else(mask, batch.column("text"), pa.scalar(None, batch.column("text").type))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), batch.column("n_bytes"), batch.column("whole"), text], ["doc_id", "row", "n_bytes", "whole", "text"])

    return run


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of `docs`.

    A byte is removed if a window of LENGTH bytes that covers it also starts earlier: in a smaller doc_id, or
    in the same text before.  Texts are whole and judged as they came in.  A null text is an empty one,
    which loses nothing.  A null id comes before all others.  Where equal windows start at the same
    place of rows that share an id, neither is earlier.  What is removed from a row is removed from rows equal
    in id and text, and from no others.  Other columns are left out; no rows give no rows.
    """
    spark = docs.sparkSession
    texts = documents(docs).withColumn("row", F.xxhash64("doc_id", "text"))
    records = texts.mapInArrow(_records, "h long, around long, doc_id long, row long, at long").repartition("h")
    alike = F.rank().over(Window.partitionBy("h", "around").orderBy("doc_id", "at"))
    anchor = Window.partitionBy("h")
    judged = records.withColumn("nth", alike).withColumn("kinds", F.min("around").over(anchor) != F.max("around").over(anchor))
    settled = F.col("at") < 0
    judged = written(judged.where(settled | (F.col("nth") > 1) | F.col("kinds")), "repeat-records")
    at = F.when(settled, F.bitwise_not("at")).otherwise(F.col("at"))
    whole = judged.where(settled | (F.col("nth") > 1)).select(
        "row", F.shiftright(at, 16).alias("start"), (F.shiftright(at, 8).bitwiseAND(255)).alias("count"))

    open_ = spark.sparkContext.broadcast(bit_table(judged.where(~settled & F.col("kinds")).select(F.col("h").alias("key"))))
    around = texts.mapInArrow(_surroundings(open_), "h long, around long, doc_id long, row long, at long, bytes binary")
    compared = written(around.repartition("h").sortWithinPartitions("h", "around", "doc_id", "at", "row").mapInArrow(
        _ordered, "doc_id long, row long, start long, d1 long, d2 long"), "repeat-windows")
    first = compared.where("d1 IS NOT NULL").groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "start")).alias("first"))
    later = compared.where("d1 IS NOT NULL").join(first, ["d1", "d2"]).where(F.struct("doc_id", "start") > F.col("first"))
    single = compared.where("d1 IS NULL").select("row", "start").unionByName(later.select("row", "start"))
    windows = whole.unionByName(single.select("row", "start", F.lit(1).alias("count")))
    by_row = written(windows.groupBy("row").agg(F.collect_set(F.struct("start", "count")).alias("windows")), "repeat-cuts")

    losing = spark.sparkContext.broadcast(bit_table(by_row.select(F.col("row").alias("key"))))
    held = texts.select(
        "doc_id", "row", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("whole"), "text",
    ).mapInArrow(_held(losing), "doc_id long, row long, n_bytes long, whole string, text string")
    met = held.join(by_row, "row", "left")
    return met.select("doc_id", "n_bytes", "whole", "text", "windows").mapInArrow(
        _cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
