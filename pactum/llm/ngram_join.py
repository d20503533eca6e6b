"""Near duplicates by an n-gram Jaccard join: rare-first prefix filtering, verified once per pair.

Texts with equal shingle sets form a class, and classes are joined.  All shingles are ordered by how many
documents their hash bucket has, rare ones first; two sets that are similar enough share a shingle among
the first few of each (the prefix).  Prefix shingles are shuffled, and each list of classes that share one
gives candidates under the length and positional filters, and a suffix filter on signatures of 512 bits: two sets
differ in as many shingles as their signatures in bits, at least.  So texts that share a passage and nothing else
make no pair.  Candidates are verified on whole sets, after a second suffix filter that bounds the overlap by the
sizes of 16 hash ranges.

A list of near copies would give all pairs.  So each list first ties its classes to its leader, the
smallest class id, which is the same one in most lists of a group, and classes still outside are compared
with a few members of their largest list; what these ties connect needs no further pair.  Then all
remaining candidate pairs between different components are verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pactum.llm.bit_tables import bit_table, hashed_ids, hit, id_hash
from pactum.llm.components import components
from pactum.llm.frames import NO_ID, documents, ids, restored, text_chunks, written
from pactum.llm.words import distinct_runs, hash_words, mixed

WIDTH, PER_CENT = 5, 80
#: Hash buckets whose document counts order the shingles: a fixed size, sent to every task.
BUCKET_BITS = 16
#: A shingle whose bucket has more documents than this is dealt over several lists.
LIST_ROWS = 20_000
#: Members of a list's largest component that a class outside it is compared with, turn by turn, before
#: all that is left is compared.
GUIDES = (4, 12)
#: Words of a set's signature: each shingle flips one of its bits, so two sets differ in at least as many shingles
#: as their signatures differ in bits.
SIGNATURE = [f"s{k}" for k in range(8)]
SIGNED_TEXTS = 1024
_U = np.uint64


def required(n: np.ndarray) -> np.ndarray:
    """The least overlap of a set of n with any set that is similar enough."""
    return -(-n * PER_CENT // 100)


def _sets(batch: pa.RecordBatch, column: str = "text"):
    """(first row, rows, shingles, text of each, size of each text's set, class of each text)."""
    for first, last, data, offsets in text_chunks(batch, column):
        h, text = distinct_runs(*hash_words(data, offsets), WIDTH)
        n = np.bincount(text, minlength=last - first)
        total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(mixed(h + _U(0x5851F42D4C957F2D)), out=total[1:])
        ends = np.cumsum(n)
        cid = mixed((total[ends] - total[ends - n]) * _U(0x9E3779B97F4A7C15) + n.astype(np.uint64))
        yield first, last - first, h, text, n, cid.view(np.int64)


def _signatures(h: np.ndarray, text: np.ndarray, rows: int) -> np.ndarray:
    """The signature of each text's set, a row of words each; some texts at a time."""
    bits, width = (mixed(h) >> _U(55)).astype(np.int64), 64 * len(SIGNATURE)
    found = np.zeros((rows, len(SIGNATURE)), np.int64)
    for start in range(0, rows, SIGNED_TEXTS):
        first, last = np.searchsorted(text, (start, start + SIGNED_TEXTS))
        some = min(SIGNED_TEXTS, rows - start)
        odd = np.bincount((text[first:last] - start) * width + bits[first:last], minlength=some * width) & 1
        found[start : start + some] = np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(some, -1)
    return found


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text its id, set size and class; at the end, the task's document counts by hash bucket."""
    names = ["doc_id", "n", "cid", *SIGNATURE, "bucket", "c"]
    counts = np.zeros(1 << BUCKET_BITS, np.int64)
    for batch in batches:
        doc = ids(batch)
        for first, rows, h, text, n, cid in _sets(batch):
            counts += np.bincount((h >> _U(64 - BUCKET_BITS)).astype(np.int64), minlength=len(counts))
            none = pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.int64())
            signed = [pa.array(word) for word in _signatures(h, text, rows).T]
            yield pa.RecordBatch.from_arrays([pa.array(doc[first : first + rows]), pa.array(n), pa.array(cid), *signed, *none], names)
    found = np.flatnonzero(counts)
    if len(found):
        none = pa.nulls(len(found), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, *[none] * len(SIGNATURE), pa.array(found.astype(np.int32)), pa.array(counts[found])], names)


def _prefixes(counts: np.ndarray):
    """Prefix shingles of each class that a task meets: token, part of its list, class, set size and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in batches:
            for _, _, h, text, n, cid in _sets(batch):
                new = np.zeros(len(n), bool)
                for k, c in enumerate(cid.tolist()):
                    if n[k] and c not in met:
                        met.add(c)
                        new[k] = True
                keep = new[text]
                h, text = h[keep], text[keep]
                often = counts.value[(h >> _U(64 - BUCKET_BITS)).astype(np.int64)]
                order = np.lexsort((often, text))  # stable: ties stay in hash order
                h, text, often = h[order], text[order], often[order]
                size = n[text]
                place = np.arange(len(h)) - np.searchsorted(text, text)
                front = place < size - required(size) + 1
                h, text, often, size, place = h[front], text[front], often[front], size[front], place[front]
                parts = 1 + often // LIST_ROWS
                part = np.where(parts > 1, (cid[text].view(np.uint64) >> _U(8)).astype(np.int64) % parts, -1)
                if len(h):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h.view(np.int64)), pa.array(part.astype(np.int32)), pa.array(cid[text]), pa.array(size.astype(np.int32)), pa.array(place.astype(np.int32))],
                        ["token", "part", "cid", "n", "place"])

    return run


def _possible(a: str, b: str) -> Column:
    """Length and positional filters for two postings of one shingle."""
    na, nb, pa_, pb = F.col(f"{a}.n"), F.col(f"{b}.n"), F.col(f"{a}.place"), F.col(f"{b}.place")
    length = F.least(na, nb) * 100 >= F.greatest(na, nb) * PER_CENT
    most = F.least(na - pa_, nb - pb)
    return length & (most * (100 + PER_CENT) >= (na + nb) * PER_CENT)


def _close(a: str, b: str) -> Column:
    """Suffix filter on signatures: whether two whole sets may be similar enough, whatever their prefixes share."""
    differ = sum((F.bit_count(F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))) for s in SIGNATURE), F.lit(0))
    return differ * (100 + PER_CENT) <= (F.col(f"{a}.n") + F.col(f"{b}.n")) * (100 - PER_CENT)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of a batch whose sets are similar enough."""
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            sides = []
            for column in ("text_a", "text_b"):
                h, pair, size = [], [], []
                for first, _, hashes, text, n, _ in _sets(part, column):
                    h.append(hashes)
                    pair.append(text + first)
                    size.append(n)
                sides.append((np.concatenate(h), np.concatenate(pair), np.concatenate(size)))
            (ha, pa_, na), (hb, pb, nb) = sides
            rows = part.num_rows
            ranges = [np.bincount(p * 16 + (h >> _U(60)).astype(np.int64), minlength=rows * 16) for h, p in ((ha, pa_), (hb, pb))]
            most = np.minimum(*ranges).reshape(rows, 16).sum(axis=1)  # suffix filter
            likely = most * (100 + PER_CENT) >= (na + nb) * PER_CENT
            h = np.concatenate([ha[likely[pa_]], hb[likely[pb]]])
            pair = np.concatenate([pa_[likely[pa_]], pb[likely[pb]]])
            order = np.lexsort((h, pair))
            h, pair = h[order], pair[order]
            both = np.bincount(pair[1:][(h[1:] == h[:-1]) & (pair[1:] == pair[:-1])], minlength=rows)
            good = likely & (na + nb > 0) & (both * 100 >= PER_CENT * (na + nb - both))
            if good.any():
                mask = pa.array(good)
                yield pa.RecordBatch.from_arrays([part.column("a").filter(mask), part.column("b").filter(mask)], ["a", "b"])


def _fitting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts that have the class they were fetched for."""
    for batch in batches:
        cids = np.concatenate([cid for *_, cid in _sets(batch)] or [np.empty(0, np.int64)])
        mask = pa.array(cids == batch.column("cid").to_numpy())
        yield pa.RecordBatch.from_arrays([batch.column("cid").filter(mask), batch.column("text").filter(mask)], ["cid", "text"])


def _among(table, column: str, hashed=None):
    """Rows whose key, by its hash, may be in the bit table: what a join needs of them is then decided exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = ids(batch, column)
            mask = hit(table.value, hashed(keys) if hashed else keys.view(np.uint64))
            if mask.any():
                yield batch.filter(pa.array(mask))

    return run


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of `docs`.

    A text's set is its distinct runs of WIDTH words (all its words, if there are fewer); two documents
    link when their sets' Jaccard similarity is PER_CENT or more, and component_id is the smallest doc_id
    reachable by links.  Null, empty and blank texts have empty sets and link with nothing.  Shingles are
    told apart by 64-bit hashes.  Rows that share a doc_id count as one node of the graph for each of their
    sets; a null id is a node smaller than all others.  Other columns are left out; no rows give no rows.
    """
    spark = docs.sparkSession
    texts = documents(docs)
    measured = written(texts.mapInArrow(
        _measure, f"doc_id long, n long, cid long, {', '.join(f'{s} long' for s in SIGNATURE)}, bucket int, c long"), "join-sets")
    signed = measured.where("bucket IS NULL").drop("bucket", "c")
    sets = signed.select("doc_id", "n", "cid")
    counts = np.zeros(1 << BUCKET_BITS, np.int64)
    for bucket, c in measured.where("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("c")).collect():
        counts[bucket] = c
    classes = sets.where("n > 0").groupBy("cid").agg(F.min("doc_id").alias("rep"))

    postings = texts.select("text").mapInArrow(_prefixes(spark.sparkContext.broadcast(counts)), "token long, part int, cid long, n int, place int")
    alike = Window.partitionBy("token", "part")
    listed = postings.withColumn("lead", F.min(F.struct("cid", "n", "place")).over(alike)).withColumn("last", F.max("cid").over(alike))
    lists = written(listed.where("part >= 0 OR lead.cid <> last").drop("last"), "join-lists")

    members = lists.select("token", F.struct("cid", "n", "place").alias("x"), "lead")
    ties = members.where((F.col("x.cid") != F.col("lead.cid")) & _possible("x", "lead"))
    leads = lists.where("part >= 0").groupBy("token").agg(F.min("lead").alias("x"), F.collect_set("lead").alias("all"))
    across = leads.select("x", F.explode("all").alias("lead")).where((F.col("x.cid") != F.col("lead.cid")) & _possible("x", "lead"))
    first = written(ties.select("x", "lead").unionByName(across).select(
        F.least("x.cid", "lead.cid").alias("a"), F.greatest("x.cid", "lead.cid").alias("b")).distinct(), "join-pairs")

    # only texts that bit tables can't clear are shuffled: of classes in lists, then of classes in the pairs asked for
    signatures = signed.where("n > 0").groupBy("cid").agg(F.min("doc_id").alias("rep"), *[F.min(s).alias(s) for s in SIGNATURE])
    needed = written(lists.select("cid").distinct().join(signatures, "cid"), "join-needed")
    reps = spark.sparkContext.broadcast(bit_table(hashed_ids(needed.select(F.col("rep").alias("doc_id")))))
    sources = needed.join(
        texts.mapInArrow(_among(reps, "doc_id", id_hash), texts.schema).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("rep"), "text"), "rep")
    bodies = written(sources.select("cid", "text").mapInArrow(_fitting, "cid long, text string"), "join-texts")

    def verified(pairs: DataFrame) -> DataFrame:
        met = spark.sparkContext.broadcast(bit_table(pairs.select(F.explode(F.array("a", "b")).alias("key"))))
        some = bodies.mapInArrow(_among(met, "cid"), bodies.schema).dropDuplicates(["cid"])
        both = pairs.join(some.select(F.col("cid").alias("a"), F.col("text").alias("text_a")), "a").join(
            some.select(F.col("cid").alias("b"), F.col("text").alias("text_b")), "b")
        return written(both.select("a", "b", "text_a", "text_b").mapInArrow(_verify, "a long, b long"), "join-links")

    links, asked = verified(first), first

    def open_lists(links: DataFrame) -> DataFrame:
        """Postings of lists whose classes aren't all connected; main is a list's largest component."""
        joined = written(components(links), "join-components")
        labelled = lists.join(joined.withColumnRenamed("node", "cid"), "cid", "left").select(
            "token", "cid", "n", "place", F.coalesce("component", "cid").alias("comp")).distinct()
        sizes = labelled.groupBy("token", "comp").agg(F.count("*").alias("size"))
        mixed_lists = sizes.groupBy("token").agg(
            F.max(F.struct("size", "comp")).alias("top"), F.count("*").alias("comps"), F.sum("size").alias("rows")).where("comps > 1")
        opened = labelled.join(mixed_lists.select("token", "rows", F.col("top.comp").alias("main")), "token")
        return written(opened.join(needed.select("cid", *SIGNATURE), "cid").select(
            "token", "rows", "main", F.struct("cid", "n", "place", "comp", *SIGNATURE).alias("x")), "join-open")

    def pairs(found: DataFrame) -> DataFrame:
        return found.select(F.least("x.cid", "y.cid").alias("a"), F.greatest("x.cid", "y.cid").alias("b")).distinct().join(asked, ["a", "b"], "left_anti")

    for turn, count in enumerate(GUIDES):
        open_ = open_lists(links)
        lone = open_.where("x.comp <> main").groupBy("x.cid").agg(F.max(F.struct("rows", "token", "x")).alias("best")).select(
            "best.token", F.col("best.x").alias("y"))
        nth = F.row_number().over(Window.partitionBy("token").orderBy(F.xxhash64("x.cid", F.lit(turn)), "x.cid"))
        guides = open_.where("x.comp = main").withColumn("nth", nth).where(F.col("nth") <= count).select("token", "x")
        more = written(pairs(lone.join(guides, "token").where(_possible("x", "y") & _close("x", "y"))), "join-pairs")
        links, asked = links.unionByName(verified(more)), asked.unionByName(more)

    # what is left: all but one end of an open pair are outside the list's main component
    open_ = open_lists(links)
    outside = open_.where("x.comp <> main").select("token", F.col("x").alias("y"))
    rest = outside.join(open_, "token").where(
        (F.col("x.comp") != F.col("y.comp")) & ((F.col("x.comp") == F.col("main")) | (F.col("x.cid") < F.col("y.cid"))) & _possible("x", "y") & _close("x", "y"))
    links = links.unionByName(verified(written(pairs(rest), "join-pairs")))

    by_rep = links.join(classes.select(F.col("cid").alias("a"), F.col("rep").alias("ra")), "a").join(
        classes.select(F.col("cid").alias("b"), F.col("rep").alias("rb")), "b")
    # an id with several sets is one node: it ties the classes that it is in
    several = sets.where("n > 0").groupBy("doc_id").agg(F.min("cid").alias("least"), F.max("cid").alias("most")).where("least <> most").select("doc_id")
    same_id = sets.where("n > 0").join(several, "doc_id", "left_semi").select("doc_id", "cid").distinct().join(classes, "cid")
    edges = by_rep.select(F.col("ra").alias("a"), F.col("rb").alias("b")).unionByName(same_id.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    final = components(edges).withColumnRenamed("node", "rep")
    of_class = classes.join(final, "rep", "left").select("cid", F.coalesce("component", "rep").alias("component_id"))
    out = sets.join(of_class, "cid", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.select(restored(), "n_shingles", restored("component_id"))
