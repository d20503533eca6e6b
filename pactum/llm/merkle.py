"""Merkle manifest of a dataset: one hash tree a source, and one over the sources.

Every ARITY consecutive nodes of a level become one node above (a last run may be shorter, even a single
node), until one is left.  A tree is cut into aligned subtrees of HEIGHT levels below their roots; one row
holds one subtree, and the roots of the subtrees are the leaves of the next round, so a source of any size
is built by many tasks in a few rounds.

Inside its row a subtree is kept in van Emde Boas order: the upper half of its levels first, then each
subtree of the lower half, both laid out by the same rule.  `addresses` works out a node's place from its
depth and number; building, looking up siblings and handing paths down all go through it.

Digests travel as 32 bytes and are hashed as lowercase hex text.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pactum.llm.frames import written

ARITY, HEIGHT = 3, 6
#: Leaves of a full subtree.
SPAN = ARITY**HEIGHT
#: Paths are handed on in batches of at least so many rows.
BATCH_ROWS = 2048
NODES = "grove string, total long, block long, root binary, tree binary"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# ---- the layout -------------------------------------------------------------------------------------------


def _nodes(levels: int) -> int:
    return (ARITY**levels - 1) // (ARITY - 1)


def address(levels: int, depth: int, number: int) -> int:
    """The place of a node in the van Emde Boas order of a complete tree of so many levels."""
    place = 0
    while levels > 1:
        upper = levels // 2
        if depth < upper:
            levels = upper
            continue
        width = ARITY ** (depth - upper)  # of the node's level, inside its lower subtree
        place += _nodes(upper) + number // width * _nodes(levels - upper)
        levels, depth, number = levels - upper, depth - upper, number % width
    return place


@functools.cache
def addresses(levels: int) -> list[list[int]]:
    """By depth, the places of all nodes of a level."""
    return [[address(levels, depth, n) for n in range(ARITY**depth)] for depth in range(levels)]


def height_of(leaves: int, total: int) -> int:
    """Levels below the root of a subtree with so many leaves, of `total` nodes on its grove's level: full
    height where the grove goes on above it, else up to the level that has one node."""
    if total > SPAN:
        return HEIGHT
    height = 0
    while ARITY**height < leaves:
        height += 1
    return height


def widths(leaves: int, height: int) -> list[int]:
    """By depth, how many nodes there are."""
    found = [leaves]
    for _ in range(height):
        found.append(-(-found[-1] // ARITY))
    return found[::-1]


def grown(leaves: list[str], height: int) -> bytes:
    """The subtree over these leaf digests; places without a node hold zeros."""
    places, width = addresses(height + 1), widths(len(leaves), height)
    store = ["0" * 64] * _nodes(height + 1)
    for n, leaf in enumerate(leaves):
        store[places[height][n]] = leaf
    for depth in range(height - 1, -1, -1):
        below = places[depth + 1]
        for n in range(width[depth]):
            run = below[ARITY * n : min(ARITY * n + ARITY, width[depth + 1])]
            store[places[depth][n]] = digest("".join([store[p] for p in run]))
    return bytes.fromhex("".join(store))


def paths(tree: bytes, leaves: int, height: int, above: bytes) -> list[bytes]:
    """For each leaf, the way from it to the root of all: for each level one byte (size of its run times 4,
    plus its place there) and the run's other digests in order; `above` is the way from the subtree's root."""
    places, width = addresses(height + 1), widths(leaves, height)
    ways = [above]
    for depth in range(1, height + 1):
        at, below = places[depth], []
        for n in range(width[depth]):
            start = n - n % ARITY
            size = min(ARITY, width[depth] - start)
            others = [tree[32 * p : 32 * p + 32] for k, p in enumerate(at[start : start + size], start) if k != n]
            below.append(b"".join([bytes([4 * size + n - start]), *others, ways[n // ARITY]]))
        ways = below
    return ways


def folded(leaf: str, way: bytes) -> tuple[str, str]:
    """The root that a leaf and its way lead to, and the digest of the way's siblings, from the leaf up."""
    at, siblings = 0, []
    while at < len(way):
        size, place = divmod(way[at], 4)
        at += 1
        run = [way[at + 32 * k : at + 32 * k + 32].hex() for k in range(size - 1)]
        at += 32 * (size - 1)
        siblings += run
        run.insert(place, leaf)
        leaf = digest("".join(run))
    return leaf, digest("".join(siblings))


# ---- the trees on Spark -----------------------------------------------------------------------------------


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """The rows with `at`, their number from 0 in their grove in the given order, and `total`, the grove's rows.

    Rows are dealt in ranges of (grove, order) and sorted inside their partition, which splits a large grove;
    a grove's number in front of a partition is summed over a table of one row a grove and partition.
    """
    place = F.monotonically_increasing_id()  # the partition, and the row there
    placed = written(
        rows.repartitionByRange("grove", *order).sortWithinPartitions("grove", *order).withColumn("place", place)
        .withColumn("part", F.shiftright("place", 33)), "merkle-order")
    runs = placed.groupBy("grove", "part").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    grove = Window.partitionBy("grove")
    runs = runs.select(
        "grove", "part", "first", (F.sum("n").over(grove.orderBy("part")) - F.col("n")).alias("before"), F.sum("n").over(grove).alias("total"))
    return placed.join(runs, ["grove", "part"]).withColumn("at", F.col("place") - F.col("first") + F.col("before")).drop("place", "part", "first", "before")


def planted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The subtree of every row's leaves, beside the row's columns."""
    for batch in batches:
        items, totals = batch.column("items"), batch.column("total").to_pylist()
        leaves = items.flatten().field("digest").to_pylist()
        trees, start = [], 0
        for total, n in zip(totals, items.value_lengths().to_pylist()):
            trees.append(grown([leaf.hex() for leaf in leaves[start : start + n]], height_of(n, total)))
            start += n
        made = [pa.array([tree[:32] for tree in trees], pa.binary()), pa.array(trees, pa.binary())]
        yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, "root", "tree"])


@dataclass
class Forest:
    """Rounds of subtrees, written tables: grove, total (nodes on its level), block, items (its leaves, with the
    columns that came along), root, tree.  `roots` has grove, root and the round that the grove ends in."""

    rounds: list[DataFrame]
    roots: DataFrame


def forest(leaves: DataFrame) -> Forest | None:
    """Trees over (grove, at, total, digest); other columns come along with a leaf.  None without a row."""
    most = leaves.agg(F.max("total")).first()[0]
    rounds: list[DataFrame] = []
    tops: list[DataFrame] = []
    level = leaves
    while most:
        held = F.struct("at", "digest", *[c for c in level.columns if c not in ("grove", "at", "total", "digest")])
        blocks = level.groupBy("grove", "total", F.floor(F.col("at") / SPAN).alias("block")).agg(F.sort_array(F.collect_list(held)).alias("items"))
        trees = written(blocks.mapInArrow(planted, f"{blocks._jdf.schema().toDDL()}, root binary, tree binary"), "merkle-blocks")
        tops.append(trees.where(F.col("total") <= SPAN).select("grove", "root", F.lit(len(rounds)).alias("round")))
        rounds.append(trees)
        level = trees.where(F.col("total") > SPAN).select(
            "grove", F.col("block").alias("at"), F.ceil(F.col("total") / SPAN).alias("total"), F.col("root").alias("digest"))
        most = -(-most // SPAN) if most > SPAN else 0
    return Forest(rounds, functools.reduce(DataFrame.unionByName, tops)) if rounds else None


def handed_down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for every leaf of every subtree: grove, at, the leaf's own columns, its path, and what came along."""
    waiting, rows = [], 0

    def joined():
        return pa.Table.from_batches(waiting).combine_chunks().to_batches()

    for batch in batches:
        items = batch.column("items")
        leaves, lengths = items.flatten(), items.value_lengths().to_pylist()
        trees, above, totals = (batch.column(c).to_pylist() for c in ("tree", "above", "total"))
        start = 0
        for k, n in enumerate(lengths):
            own = leaves.slice(start, n)
            start += n
            ways = paths(trees[k], n, height_of(n, totals[k]), above[k])
            same = pa.array(np.full(n, k))
            columns = {name: batch.column(name).take(same) for name in ("grove", "subroot")}
            columns |= {field.name: own.field(field.name) for field in own.type}
            waiting.append(pa.RecordBatch.from_pydict(columns | {"path": pa.array(ways, pa.binary())}))
            rows += n
            if rows >= BATCH_ROWS:
                yield from joined()
                waiting, rows = [], 0
    if waiting:
        yield from joined()


def all_paths(trees: Forest, tops: DataFrame) -> DataFrame:
    """grove, subroot, at, digest, path, and what came along, of every leaf.  `tops` has grove, subroot, and
    `above`, the way that goes on from the grove's root (empty bytes where it ends there)."""
    tops = trees.roots.select("grove", "round").join(tops, "grove")
    down: DataFrame | None = None
    for n in range(len(trees.rounds) - 1, -1, -1):
        above = tops.where(F.col("round") == n).select("grove", F.lit(0).cast("long").alias("block"), "subroot", "above")
        if down is not None:
            above = above.unionByName(down.select("grove", F.col("at").alias("block"), "subroot", F.col("path").alias("above")))
        blocks = trees.rounds[n].join(above, ["grove", "block"])
        held = trees.rounds[n].schema["items"].dataType.elementType
        carried = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held)
        down = blocks.select("grove", "total", "items", "tree", "subroot", "above").mapInArrow(handed_down, f"grove string, subroot binary, {carried}, path binary")
    return down


# ---- documents --------------------------------------------------------------------------------------------


def leaf_of(*values: Column) -> Column:
    """H of the values: each `-` if null, else its UTF-8 byte count, `:` and itself."""
    text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256)


def without_line_feeds(docs: DataFrame) -> Column:
    """The text after tampering: without line feeds, where 2 divides the crc32 of the decimal id."""
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    text = F.col("text").cast("string")
    return F.when(F.coalesce(even, F.lit(False)), F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)


@dataclass
class Manifest:
    """Trees by source, the tree over the sources, and the root as hex text."""

    sources: Forest
    top: Forest
    root: str


def manifest(docs: DataFrame, tampered: Column | None = None) -> Manifest | None:
    """The manifest of documents: leaves of doc_id, source, lang, n_chars and text, in trees by source, under a
    tree of the sources' roots.  None without a row.

    Leaves go by doc_id (null first), rows of one id by their digest; rows that are alike in all five columns
    are leaves each.  A null source is a source, before all others; an empty one is another.  Other columns
    are left out.  With `tampered`, a text to check instead of the one that was stored, each leaf carries the
    digest of that as `changed`.
    """
    names = ["doc_id", "source", "lang", "n_chars"]
    fields = [F.col("doc_id").cast("long"), F.col("source"), F.col("lang"), F.col("n_chars").cast("long")]
    text = F.col("text").cast("string")
    changed = F.lit(None).cast("string") if tampered is None else F.when(~tampered.eqNullSafe(text), leaf_of(*fields, tampered))
    # a source's key sorts as the source does, and null before all
    grove = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    leaves = docs.select(*names, "text").select(
        grove.alias("grove"), fields[0].alias("doc_id"), F.unhex(leaf_of(*fields, text)).alias("digest"), F.unhex(changed).alias("changed"),
        # tells equal rows apart, so that many of them don't end in one range; fixed by the write
        F.monotonically_increasing_id().alias("row"))
    trees = forest(numbered(written(leaves, "merkle-leaves"), "doc_id", "digest", "row").drop("row"))
    if trees is None:
        return None
    subroots = trees.roots.select(F.lit("").alias("grove"), F.col("grove").alias("source"), F.col("root").alias("digest"))
    top = forest(numbered(subroots, "source"))
    return Manifest(trees, top, top.roots.first().root.hex())


def proofs(held: Manifest) -> DataFrame:
    """doc_id, digest, changed, subroot and path of every leaf."""
    session = held.sources.roots.sparkSession
    # one row: there is one tree of sources
    start = session.createDataFrame([("", b"", b"")], "grove string, subroot binary, above binary")
    tops = all_paths(held.top, start).select(F.col("source").alias("grove"), F.col("digest").alias("subroot"), F.col("path").alias("above"))
    return all_paths(held.sources, tops).select("doc_id", "digest", "changed", "subroot", "path")


REPORT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def verification(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256 of every document as it is, and folded_root, verified for the
    tampered text (`without_line_feeds`) under the original siblings.

    Cases as in `manifest`; a row without an id isn't tampered with, nor is a null text.  No rows give no rows.
    """
    held = manifest(docs, without_line_feeds(docs))
    if held is None:
        return docs.sparkSession.createDataFrame([], REPORT)
    root = held.root

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves, changed, subroots, ways = (batch.column(c).to_pylist() for c in ("digest", "changed", "subroot", "path"))
            ends = [folded((new or leaf).hex(), way) for leaf, new, way in zip(leaves, changed, ways)]
            reached = [end for end, _ in ends]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([leaf.hex() for leaf in leaves], pa.string()), pa.array([s.hex() for s in subroots], pa.string()),
                pa.array([root] * len(ends), pa.string()), pa.array([proof for _, proof in ends], pa.string()), pa.array(reached, pa.string()),
                pa.array([end == root for end in reached], pa.bool_()),
            ], ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return proofs(held).mapInArrow(verified, REPORT)


#: The report in DuckDB's SQL: levels by recursion, then each leaf's way up.
ORACLE_SQL = f"""
WITH RECURSIVE
field AS (
  SELECT row_number() OVER () AS r, doc_id, source,
    list_transform([CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR)], lambda v: coalesce(CAST(strlen(v) AS VARCHAR) || ':' || v, '-')) AS f, text,
    list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, strlen(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), i, 1)) AS BIGINT))),
      lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda d, n: xor(d >> 1, (d & 1) * 3988292384::BIGINT))) % 2 = 1 AS even
  FROM documents
),
leaf AS (
  SELECT r, doc_id, source, sha256(array_to_string(f, '') || coalesce(CAST(strlen(text) AS VARCHAR) || ':' || text, '-')) AS h,
    sha256(array_to_string(f, '') || coalesce(CAST(strlen(changed) AS VARCHAR) || ':' || changed, '-')) AS tampered
  FROM (SELECT *, CASE WHEN even THEN replace(text, chr(10), '') ELSE text END AS changed FROM field)
),
placed AS (
  SELECT *, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS grove,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h, r) - 1 AS i, count(*) OVER (PARTITION BY source) AS total
  FROM leaf
),
node(grove, lvl, i, total, h) AS (
  SELECT grove, 0::BIGINT, i, total, h FROM placed
  UNION ALL
  SELECT grove, lvl + 1, i // {ARITY}, (total + {ARITY - 1}) // {ARITY}, sha256(string_agg(h, '' ORDER BY i)) FROM node WHERE total > 1 GROUP BY grove, lvl, i // {ARITY}, total
),
subroot AS (SELECT grove, lvl, h, row_number() OVER (ORDER BY encode(grove)) - 1 AS i, count(*) OVER () AS total FROM node WHERE total = 1),
top(lvl, i, total, h) AS (
  SELECT 0::BIGINT, i, total, h FROM subroot
  UNION ALL
  SELECT lvl + 1, i // {ARITY}, (total + {ARITY - 1}) // {ARITY}, sha256(string_agg(h, '' ORDER BY i)) FROM top WHERE total > 1 GROUP BY lvl, i // {ARITY}, total
),
every AS (SELECT grove, lvl, i, total, h FROM node UNION ALL SELECT NULL, lvl, i, total, h FROM top),
way(r, grove, home, lvl, i, h, proof, done) AS (
  SELECT r, grove, grove, 0::BIGINT, i, tampered, '', false FROM placed
  UNION ALL
  SELECT way.r, CASE WHEN any_value(every.total) = 1 THEN NULL ELSE way.grove END, way.home,
    CASE WHEN any_value(every.total) = 1 THEN 0 ELSE way.lvl + 1 END,
    CASE WHEN any_value(every.total) = 1 THEN any_value(subroot.i) ELSE way.i // {ARITY} END,
    CASE WHEN any_value(every.total) = 1 THEN any_value(way.h) ELSE sha256(string_agg(CASE WHEN every.i = way.i THEN way.h ELSE every.h END, '' ORDER BY every.i)) END,
    any_value(way.proof) || coalesce(string_agg(every.h, '' ORDER BY every.i) FILTER (every.i <> way.i), ''),
    any_value(every.total) = 1 AND way.grove IS NULL
  FROM way
  JOIN every ON every.grove IS NOT DISTINCT FROM way.grove AND every.lvl = way.lvl AND every.i // {ARITY} = way.i // {ARITY}
  JOIN subroot ON subroot.grove = way.home
  WHERE NOT way.done
  GROUP BY way.r, way.grove, way.home, way.lvl, way.i
)
SELECT placed.doc_id, placed.h AS leaf, subroot.h AS subroot, root.h AS root, sha256(way.proof) AS proof_sha256, way.h AS folded_root, way.h = root.h AS verified
FROM placed JOIN subroot USING (grove) JOIN way ON way.r = placed.r AND way.done CROSS JOIN (SELECT h FROM top WHERE total = 1) AS root
"""
