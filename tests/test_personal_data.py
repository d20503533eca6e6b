"""Personal data: the patterns against plain regular expressions, on odd and very long texts, and contract flags."""

import random
import re
import time

from pyspark.sql import functions as F

from pactum.functions import pii
from pactum.operators import profile, remediate
from pactum.types import Contract, Rule

# with groups that go back: right, but neither fast nor safe on long texts
PLAIN = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"


def test_addresses_equal_the_plain_pattern(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice("ab1.@@-_. cD" if n % 2 else "ab.@c1") for _ in range(rng.randrange(40))) for n in range(20_000)]
    texts += ["a@b.comx.y@c.org", "@b.com@c.org", "a@b.com@c.org", "a@b..com", "a@.b.com", "a@b.c.com1", "a@b.c1.d2.eee4.f5", "x..y@a-b.co.uk.", "a@b.c"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", pii.count_emails(F.col("t")).alias("n"), pii.KINDS[0].masked(F.col("t")).alias("m")).collect()
    for t, n, m in rows:
        assert (n, m) == (len(re.findall(PLAIN, t)), re.sub(PLAIN, "<email>", t)), t


def test_long_texts_take_linear_time_and_constant_stack(spark):
    texts = {
        "labels": "x@" + "b." * 50_000 + "com",
        "letter labels": "x@" + "bcd." * 50_000 + "com!",
        "no ending": "x@" + "b." * 50_000 + "c",
        "endings and others": "x@" + "bcd.1." * 50_000 + "1",
        "run": "a" * 1_000_000 + " b@c.de",
        "run before": "a" * 1_000_000 + "@c.de",
        "many": "a@b.co." * 150_000,
        "signs": "@" * 1_000_000,
        "dots": "a@" + "." * 1_000_000,
        "digits": "5" * 1_000_000,
        "digit groups": "555-" * 250_000,
        "local": "l" * 80 + "@example.org",
    }
    want = {"labels": 1, "letter labels": 1, "no ending": 0, "endings and others": 1, "run": 1, "run before": 1, "many": 150_000, "local": 1}
    df = spark.createDataFrame(list(texts.items()), "name string, t string").repartition(1).cache()
    df.count()
    started = time.time()
    found = {r.name: r.n for r in df.select("name", pii.count_emails(F.col("t")).alias("n")).collect()}
    masked = {r.name: r.t for r in remediate.mask_pii(df, ["t"]).collect()}
    profile.pii_counts(df, "name", "t").collect()
    assert time.time() - started < 20  # some 36 passes over 1 MB each
    assert found == {name: want.get(name, 0) for name in texts}
    assert masked["labels"] == masked["local"] == "<email>" and masked["letter labels"] == "<email>!" and masked["run"].endswith(" <email>")
    # the last label that begins with two letters ends it
    assert masked["endings and others"] == "<email>.1.1" and masked["no ending"] == texts["no ending"]


def test_review_of_flags(spark):
    rows = [(1, "a@b.co", "call 212-555-0187 or 078-05-1120", "x"), (2, "nobody", "a@b.co c@d.org", None), (3, None, "", " ")]
    df = spark.createDataFrame(rows, "ID int, mail string, note string, name string")
    contract = Contract("c", [Rule("id"), Rule("Mail", pii=True), Rule("note"), Rule("NAME", pii=True), Rule("gone", pii=True)])
    got = {r["column"]: (r.cells, r.cells_with_pii, r.emails, r.ssns, r.phones, r.flagged, r.verdict) for r in profile.pii_review(df, contract, F.lit("d")).collect()}
    assert got == {
        "ID": (3, 0, 0, 0, 0, False, "none"), "mail": (2, 1, 1, 0, 0, True, "declared"),
        "note": (3, 2, 2, 1, 1, False, "undeclared"), "name": (2, 0, 0, 0, 0, True, "unseen"),
    }
    assert [tuple(r) for r in remediate.mask_flagged(df, contract).orderBy("ID").collect()] == [
        (1, "<email>", rows[0][2], "<masked>"), (2, "<masked>", rows[1][2], None), (3, None, "", " ")]
    assert remediate.drop_pii(df, contract).columns == ["ID", "note"]
    empty = {r["column"]: r.cells for r in profile.pii_review(df.limit(0), contract, F.lit("d")).collect()}
    assert empty == {"ID": 0, "mail": 0, "note": 0, "name": 0}
