"""Token counts by byte-pair merging with a heap and a linked list; no identifiers are made.

A text is split by the vocabulary's pattern, each piece's bytes are its first symbols, and the adjacent
pair of lowest rank (leftmost of equals) is merged until none has a rank: count = symbols - merges.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Strings whose counts a Python worker remembers at most, of each of three kinds.
MEMO_STRINGS = 1_000_000
#: Rows of a batch handed to Python: bounds the memory that long texts take.
BATCH_ROWS = 256

# The byte-level alphabet and the pattern that byte-level vocabularies split by.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

SPACES = re.compile(r"(?<=\S) (?=\S)")
SPACE_BEFORE, SPACE_AFTER = re.compile(r" (?:\s|\Z)"), re.compile(r"(?:[^\S ]|\A) ")


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: itself if it shows, else the next unused from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(256 + hidden.index(b)) if b in hidden else chr(b) for b in range(256)]


def merges_left(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Symbols that are left when no adjacent pair can be merged."""
    left = n = len(symbols)
    get = ranks.get
    rank_at = list(map(get, zip(symbols, symbols[1:])))
    heap = [rank << 40 | i for i, rank in enumerate(rank_at) if rank is not None]
    if not heap:
        return n
    heapq.heapify(heap)
    rank_at.append(None)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while heap:
        top = heapq.heappop(heap)
        i = top & 0xFFFFFFFFFF
        if rank_at[i] != top >> 40:
            continue  # the pair has changed since
        j = after[i]
        symbols[i] += symbols[j]
        left -= 1
        after[i] = k = after[j]
        rank_at[j] = rank_at[i] = None
        if k < n:
            before[k] = i
            rank_at[i] = rank = get((symbols[i], symbols[k]))
            if rank is not None:
                heapq.heappush(heap, rank << 40 | i)
        k = before[i]
        if k >= 0:
            rank_at[k] = rank = get((symbols[k], symbols[i]))
            if rank is not None:
                heapq.heappush(heap, rank << 40 | k)
    return left


class Memo(dict):
    """Remembers what `work` gives for short strings, MEMO_STRINGS at most: when the younger half is full,
    the older one is let go."""

    def __init__(self, work: Callable[[str], int]):
        super().__init__()
        self.work, self.older = work, {}

    def __missing__(self, string: str) -> int:
        count = self.older.get(string)
        if count is None:
            count = self.work(string)
        if len(string) <= 64:
            if len(self) >= MEMO_STRINGS // 2:
                self.older = dict(self)
                self.clear()
            self[string] = count
        return count


@functools.cache
def vocabulary(path: str) -> tuple[Memo, Memo, regex.Pattern | None]:
    """Counts of strings as they are and behind a space, and a pattern of the special strings."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    cut = spec["pre_tokenizer"]
    if spec["normalizer"] or spec["model"].get("ignore_merges") or cut["type"] != "ByteLevel" or cut["add_prefix_space"]:
        raise ValueError(f"{path}: only plain byte-level pair merging is supported")
    ranks = {(tuple(m.split(" ")) if isinstance(m, str) else tuple(m)): k for k, m in enumerate(spec["model"]["merges"])}
    letters = dict(enumerate(byte_alphabet()))
    pieces = Memo(lambda piece: merges_left(list(piece.encode().decode("latin-1").translate(letters)), ranks))
    plain = Memo(lambda string: sum(map(pieces.__getitem__, PIECES.findall(string))))
    spaced = Memo(lambda string: sum(map(pieces.__getitem__, PIECES.findall(" " + string))))
    special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
    return plain, spaced, regex.compile("|".join(map(regex.escape, special))) if special else None


def count_tokens(text: str, path: str) -> int:
    """A space between two characters that aren't white space always begins a piece, so what lies
    between such spaces is counted by itself."""
    plain, spaced, special = vocabulary(path)
    parts = special.split(text) if special else [text]
    total = len(parts) - 1
    for part in parts:
        lone = not (SPACE_BEFORE.search(part) or SPACE_AFTER.search(part))
        first, *others = part.split(" ") if lone else SPACES.split(part)
        total += plain[first] + sum(map(spaced.__getitem__, others))
    return total


def token_counts(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of `docs`, by the vocabulary file at `path`.

    A null or empty text has no bytes and no tokens.  Special strings inside a text count as one token
    each, as the vocabulary's library has it by default.  Repeated rows and null ids stay as they are, other
    columns are left out, and no rows give no rows.  Every executor must be able to read `path`; the file
    is a part of the installation, not data.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(start, BATCH_ROWS)
                found = [count_tokens(text, path) if text else 0 for text in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), pa.array(found, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    texts = docs.select(
        F.col("doc_id").cast("long"), F.col("text").cast("string"),
        F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long").alias("n_bytes"),
    )
    return texts.mapInArrow(counted, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
