"""Near duplicates and repeated bytes against brute force."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pactum.llm import ngram_join, repeated_bytes
from pactum.llm.components import components
from pactum.llm.suffix_order import suffix_order
from tests.llm.conftest import texts_of, words

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
NONE = -(1 << 63)


def shingles(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(LOWER))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute_components(texts):
    sets = [(NONE if i is None else i, shingles(t)) for i, t in texts]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (a, sa) in enumerate(sets):
        for b, sb in sets[:n]:
            if sa and sb and 100 * len(sa & sb) >= 80 * len(sa | sb):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return Counter((i, len(s), find(i) if s else i) for i, s in sets)


def found_components(df):
    return Counter(tuple(NONE if x is None else x for x in r) for r in df.select("doc_id", "n_shingles", "component_id").collect())


def test_near_duplicates_equal_brute_force(docs):
    assert found_components(ngram_join.near_duplicates(docs)) == brute_components(texts_of(docs))


def test_a_large_group_of_near_copies_and_split_lists(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "LIST_ROWS", 7)
    base, rows = words(5, 60), []
    rng = random.Random(4)
    for k in range(90):
        near = list(base)
        for _ in range(rng.randrange(4)):
            near[rng.randrange(60)] = f"edit{rng.randrange(40)}"
        rows.append((k, " ".join(near)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found_components(ngram_join.near_duplicates(df)) == brute_components(rows)


def test_an_id_with_several_texts_ties_their_groups(spark):
    a, b, c, d = (" ".join(words(seed, 30)) for seed in (1, 2, 3, 4))
    rows = [(5, a), (5, b), (3, b), (9, a), (8, c), (8, c), (8, ""), (8, None), (2, d), (None, d), (None, c), (4, c + " more")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = found_components(ngram_join.near_duplicates(df))
    assert got == brute_components(rows)
    assert {i: comp for i, n, comp in got if n and i in (3, 5, 9)} == {3: 3, 5: 3, 9: 3}


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(100, 140)] + [(7, k) for k in range(8, 60)] + [(3, 3), (300, 290)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {k: 100 for k in range(100, 141)} | {k: 7 for k in range(7, 60)} | {300: 290, 290: 290}
    assert got == want


def brute_repeats(texts):
    first = {}
    for i, text in texts:
        b = (text or "").encode()
        for s in range(len(b) - 99):
            at = (NONE if i is None else i, s)
            first[b[s : s + 100]] = min(first.get(b[s : s + 100], at), at)
    out = []
    for i, text in texts:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            if first[b[s : s + 100]] < (NONE if i is None else i, s):
                gone[s : s + 100] = b"\1" * 100
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), len(bytes(gone).replace(b"\0", b" ").split()), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("rows_together", [4096, 2])
def test_repeats_equal_brute_force(docs, monkeypatch, rows_together):
    monkeypatch.setattr(repeated_bytes, "ORDER_ROWS", rows_together)  # 2: windows by digests
    got = repeated_bytes.remove_repeats(docs)
    assert Counter(map(tuple, got.collect())) == brute_repeats(texts_of(docs))


@pytest.mark.parametrize("rows_together", [4096, 2])
def test_repeats_of_texts_that_share_an_id(spark, monkeypatch, rows_together):
    monkeypatch.setattr(repeated_bytes, "ORDER_ROWS", rows_together)
    shared, own = " ".join(words(1, 60)), [" ".join(words(10 + k, 80)) for k in range(8)]
    rows = [(1, shared), (1, shared), (1, None), (1, ""), (1, "short"), (None, ""), (None, None), (None, "short")]
    rows += [(None, own[0][:50] + shared[:150] + own[0][50:]), (None, own[1]), (None, own[2][:300] + shared[:150] + own[2][300:])]
    rows += [(None, own[3][:90] + shared[200:340] + own[3][90:]), (None, own[4][:90] + shared[200:340] + own[4][90:])]  # at one place
    rows += [(7, own[5] + shared), (7, own[6]), (7, "tiny"), (7, own[7][:90] + shared[180:350]), (7, own[7][:90] + shared[180:350] + own[6])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert Counter(map(tuple, repeated_bytes.remove_repeats(df).collect())) == brute_repeats(rows)


def test_suffix_order():
    rng = random.Random(3)
    for _ in range(200):
        texts = [bytes(rng.choice(b"abc") for _ in range(rng.randrange(14))) for _ in range(4)]
        base, want = 0, []
        for t, text in enumerate(texts):
            want += [(text[k:], t, base + k) for k in range(len(text))]
            base += len(text) + 1
        assert suffix_order(texts) == [w[-1] for w in sorted(want)]


def test_empty_tables(nothing):
    assert ngram_join.near_duplicates(nothing).count() == 0
    assert repeated_bytes.remove_repeats(nothing).count() == 0


def test_nothing_repeats_or_links(spark):
    df = spark.createDataFrame([(1, "short"), (2, "other words")], "doc_id long, text string")
    assert {r.component_id for r in ngram_join.near_duplicates(df).collect()} == {1, 2}
    assert repeated_bytes.remove_repeats(df).agg(F.sum("n_removed")).first()[0] == 0


def test_repeated_windows_as_by_comparing_all_windows():
    rng = random.Random(11)
    base = bytes(rng.choice(b"ab") for _ in range(300))
    rows = []
    for r in range(30):
        count, start = rng.randrange(1, 60), rng.randrange(0, 150)
        rows.append((rng.randrange(0, 4), r, rng.randrange(0, 99) << 16 | count << 8 | 3, base[start : start + count - 1 + repeated_bytes.LENGTH]))
    windows = [(b[k : k + repeated_bytes.LENGTH], d, (at >> 16) + k, r) for d, r, at, b in rows for k in range(at >> 8 & 255)]
    first = {}
    for w, d, s, _ in windows:
        first[w] = min(first.get(w, (d, s)), (d, s))
    want = sorted((r, s) for w, d, s, r in windows if (d, s) != first[w])
    assert sorted(repeated_bytes.repeated_windows(rows)) == want
