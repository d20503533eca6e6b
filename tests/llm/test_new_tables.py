"""Centroid clustering, byte-pair round trips, Merkle manifests."""

import base64
import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import functions as F

from pactum.llm import byte_pairs, centroids, merkle

# ---- clustering -------------------------------------------------------------------------------------------


def brute_clusters(rows, k, rounds, dims):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]

    def key(row):
        return (row[0] is None, hashlib.sha256(f"1:{row[0]}".encode()).hexdigest() if row[0] is not None else "", row[1])

    means = [v for _, v in sorted(kept, key=key)[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(means))

    for _ in range(rounds):
        owners = [nearest(v)[1] for _, v in kept]
        for n in range(len(means)):
            own = [v for (_, v), o in zip(kept, owners) if o == n]
            if own:
                means[n] = [sum(c) // len(own) for c in zip(*own)]
    ended = [(i, *nearest(v)) for i, v in kept]
    inertia = Counter()
    for _, d, n in ended:
        inertia[n] += d
    return Counter((i, n, d, inertia[n], sum(inertia.values()), hashlib.sha256(",".join(map(str, means[n])).encode()).hexdigest()) for i, d, n in ended)


def vectors():
    rng = random.Random(11)
    rows = [(k, [rng.gauss(rng.choice((-1, 0, 1)), 0.2) for _ in range(8)]) for k in range(300)]
    rows += [(400 + k, rows[3][1]) for k in range(150)]  # copies
    rows += [(3, rows[3][1]), (3, rows[7][1])]  # repeated rows and ids
    rows += [(600, None), (601, []), (602, [0.5] * 7), (603, [0.5] * 9), (604, [None] + [0.5] * 7), (605, [float("nan")] * 8), (606, [float("inf")] + [0.0] * 7)]
    rows += [(700, [0.25] * 8), (701, [-0.25] * 8), (702, [0.0] * 8), (None, [0.1] * 8), (703, [0.015] * 7 + [-0.001])]
    return rows


def test_clusters_equal_brute_force(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cluster", F.lit("x")).repartition(3)
    got = centroids.cluster_report(df, k=7, dims=8).collect()
    assert Counter(tuple(r) for r in got) == brute_clusters(rows, 7, 3, 8)
    assert centroids.cluster_report(df.limit(0), k=7, dims=8).count() == 0


def test_fewer_vectors_than_centroids_and_no_ids(spark):
    rows = [(None, [0.5, 1.0]), (None, [0.25, 1.0]), (2, [3.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = centroids.cluster_report(df, k=16, dims=2).collect()
    assert Counter(tuple(r) for r in got) == brute_clusters(rows, 16, 3, 2)


def test_nearest_in_longs_and_in_python_integers():
    rng = np.random.default_rng(5)
    for _ in range(20):
        means = rng.integers(-9, 9, (12, 6))
        means[3:5] = means[0]  # equal centroids: the smaller number wins
        x = np.concatenate([rng.integers(-9, 9, (200, 6)), means])
        apart = ((x[:, None] - means[None]) ** 2).sum(axis=2)
        for kind in (np.int64, object):
            found, best = centroids.Centroids(means.astype(kind)).nearest(x.astype(kind))
            assert found.tolist() == apart.argmin(axis=1).tolist() and [int(d) for d in best] == apart.min(axis=1).tolist()


def test_large_components_are_exact(spark):
    rows = [(k, [1e12 + k, -1e12]) for k in range(6)] + [(9, [-1e12, 1e12])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    small = centroids.cluster_vectors(df, k=7, rounds=2, dims=2)[0].collect()
    assert {(r.vec_id, r.distance) for r in small} == {(i, 0) for i, _ in rows}


# ---- byte pairs -------------------------------------------------------------------------------------------

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    rng = random.Random(12)
    spans = [(32, 127), (1, 0x300), (0x300, 0x3000), (0x4E00, 0xA000), (0xE000, 0x11000), (0x1F300, 0x1FA00)]
    texts = ["".join(chr(rng.randrange(*rng.choice(spans))) if rng.random() < 0.8 else rng.choice(" \t\n\r\x1c\x85\xa0'") for _ in range(rng.randrange(60))) for _ in range(400)]
    return texts + ["", "<|endoftext|>", "don't I'LL we'Ve", " " * 500, "\n" * 77, "a" * 5000, "xyz" * 3000, "é" * 999, "1" * 4001, "word " * 300_000]


def test_encoding_equals_the_library():
    vocabulary, pattern, other = byte_pairs.vocabulary_at(PATH), regex.compile(public_tokenizers.PATTERN), library()
    texts = odd_texts()
    ids, counts = byte_pairs.encoded_texts([None, *texts], vocabulary, pattern)
    want = [other.encode_ordinary(t) for t in texts]
    assert counts.tolist() == [0] + [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]
    data, sizes = byte_pairs.decoded_bytes(ids, counts, vocabulary)
    assert data.tobytes() == "".join(texts).encode() and sizes.tolist() == [0] + [len(t.encode()) for t in texts]


def test_perfect_hash_is_minimal_and_rejects_other_strings():
    rng = random.Random(3)
    strings = list({rng.randbytes(rng.randrange(1, 20)) for _ in range(3000)})
    table = byte_pairs.PerfectHash(strings)
    assert sorted(table.slot_of.tolist()) == list(range(len(strings)))
    asked = strings + [s + b"\0" for s in strings] + [rng.randbytes(5) for _ in range(500)] + [b"", b"x" * 400]
    sizes = np.array([len(s) for s in asked])
    found = table.find(np.frombuffer(b"".join(asked), np.uint8), np.cumsum(sizes) - sizes, sizes)
    where = {s: n for n, s in enumerate(strings)}
    assert found.tolist() == [where.get(s, -1) for s in asked]


def test_merges_of_bytes_without_a_longer_token():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"abab": 257, b"bb": 258}
    assert byte_pairs.merged(b"ababb", ranks, 4) == [257, 98]
    assert byte_pairs.merged(b"xyz", ranks, 4) == [120, 121, 122] and byte_pairs.merged(b"", ranks, 4) == []


def test_pieces_merged_at_once_as_one_by_one(tmp_path):
    rng = random.Random(5)
    tokens = [bytes([b]) for b in range(256)] + [b"ab", b"bb", b"abab", b"ba", b"aba", b"bab", b"abb", b"bba"]
    ranked = tmp_path / "ranks.tiktoken"
    ranked.write_text("".join(f"{base64.b64encode(t).decode()} {n}\n" for n, t in enumerate(tokens)))
    vocabulary = byte_pairs.Vocabulary(str(ranked))
    pieces = [bytes(rng.choice(b"abc") for _ in range(rng.randrange(2, 40))) for _ in range(2000)]
    sizes = np.array([len(p) for p in pieces])
    ids, counts = byte_pairs.merged_all(np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(sizes) - sizes, sizes, vocabulary)
    want = [byte_pairs.merged(p, vocabulary.ranks, vocabulary.hash.longest) for p in pieces]
    assert counts.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]


def test_round_trip_of_documents(docs, nothing):
    other = library()
    rows = docs.select("doc_id", "text").collect()
    want = Counter()
    for r in rows:
        ids = other.encode_ordinary(r.text or "")
        want[(r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in byte_pairs.round_trip(docs, PATH, public_tokenizers.PATTERN).collect()) == want
    coded = byte_pairs.encode(docs, PATH, public_tokenizers.PATTERN)
    decoded = byte_pairs.decode(coded.withColumn("decoded", F.lit("x")), PATH)
    assert Counter((r.doc_id, bytes(r.decoded)) for r in decoded.collect()) == Counter((r.doc_id, (r.text or "").encode()) for r in rows)
    assert byte_pairs.round_trip(nothing, PATH, public_tokenizers.PATTERN).count() == 0
    assert byte_pairs.decode(byte_pairs.encode(nothing, PATH, public_tokenizers.PATTERN), PATH).count() == 0


# ---- manifest ---------------------------------------------------------------------------------------------


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_leaf(row, text):
    values = [row.doc_id, row.source, row.lang, row.n_chars, text]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def brute_tree(level):
    """The root, and for each leaf its runs: (place, digests) from below."""
    ways, at = [[] for _ in level], list(range(len(level)))
    while len(level) > 1:
        runs = [level[k : k + 3] for k in range(0, len(level), 3)]
        for leaf, n in enumerate(at):
            ways[leaf].append((n % 3, runs[n // 3]))
        level, at = [sha("".join(run)) for run in runs], [n // 3 for n in at]
    return level[0], ways


def brute_report(rows):
    by_source = {}
    for r in rows:
        by_source.setdefault(r.source, []).append(r)
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        leaves = sorted(((r.doc_id is not None, r.doc_id or 0, brute_leaf(r, r.text)), r) for r in by_source[s])
        trees[s] = (leaves, *brute_tree([key[2] for key, _ in leaves]))
    root, tops = brute_tree([trees[s][1] for s in sources])
    found = Counter()
    for s, top in zip(sources, tops):
        leaves, subroot, ways = trees[s]
        for (key, r), way in zip(leaves, ways):
            text = r.text
            if r.doc_id is not None and text is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0:
                text = text.replace("\n", "")
            end, siblings = brute_leaf(r, text), ""
            for place, run in way + top:
                siblings += "".join(run[:place] + run[place + 1 :])
                end = sha("".join(run[:place] + [end] + run[place + 1 :]))
            found[(r.doc_id, key[2], subroot, root, sha(siblings), end, end == root)] += 1
    return found


def test_layout_is_a_bijection_that_keeps_subtrees_together():
    for levels in range(1, 8):
        places = [p for level in merkle.addresses(levels) for p in level]
        assert sorted(places) == list(range((3**levels - 1) // 2))
    # four levels: the upper two first, then each lower subtree in one piece
    table = merkle.addresses(4)
    assert table[0] + table[1] == [0, 1, 2, 3]
    for n in range(9):
        own = [table[2][n], *table[3][3 * n : 3 * n + 3]]
        assert own == list(range(4 + 4 * n, 8 + 4 * n))


def test_subtrees_equal_plain_levels():
    for n in (1, 2, 3, 4, 9, 10, 28, 100, 729):
        leaves = [sha(str(k)) for k in range(n)]
        root, ways = brute_tree(leaves)
        height = merkle.height_of(n, n)
        tree = merkle.grown(leaves, height)
        assert tree[:32].hex() == root
        for leaf, way, path in zip(leaves, ways, merkle.paths(tree, n, height, b"")):
            siblings = "".join("".join(run[:place] + run[place + 1 :]) for place, run in way)
            assert merkle.folded(leaf, path) == (root, sha(siblings))


def check_manifest(df):
    got = Counter(tuple(r) for r in merkle.verification(df).collect())
    assert got == brute_report(df.select("doc_id", "text", "lang", "source", "n_chars").collect())
    return got


def test_manifest_equals_brute_force(docs, nothing):
    check_manifest(docs.withColumn("source", F.when(F.col("doc_id") < 30, F.concat(F.lit("s"), F.col("doc_id") % 4)).when(F.col("doc_id") < 42, "")).withColumn("root", F.lit("x")))
    assert merkle.verification(nothing).count() == 0
    assert merkle.manifest(nothing) is None


def test_manifest_of_many_rows_sources_and_copies(spark):
    """Three rounds would take 531,441 rows of a source; here one source takes two, with a last subtree of one
    leaf, and the sources' own tree takes two as well."""
    big = spark.range(729 * 2 + 1).selectExpr("id - 5 AS doc_id", "concat('line', chr(10), id % 7) AS text", "'big' AS source")
    same = spark.range(900).selectExpr("7L AS doc_id", "'copy' AS text", "'same' AS source")
    small = spark.range(800).selectExpr("id AS doc_id", "if(id % 3 = 0, NULL, 'x') AS text", "concat('é', id) AS source")
    df = big.unionByName(same).unionByName(small).withColumn("lang", F.lit(None).cast("string")).withColumn("n_chars", F.col("doc_id") * 2)
    got = check_manifest(df)
    assert {r[6] for r in got} == {True, False}
