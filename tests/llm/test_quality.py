import math
import random
from collections import Counter

from pyspark.sql import functions as F

from shardwise.llm import quality
from tests.llm.cases import documents, frame, prose


def test_radix_search(spark):
    """The k largest, ties by the second column, rows equal in both together."""
    rng = random.Random(6)
    values = [(rng.choice([rng.randint(-(1 << 62), 1 << 62), rng.randint(-5, 5)]), rng.randint(-3, 3)) for _ in range(300)]
    df = spark.createDataFrame(values, "v long, t long")
    for k in (0, 1, 7, 150, 200, 299, 300, 400):
        least = sorted(values, reverse=True)[k - 1] if 0 < k <= len(values) else None
        want = sum(v >= least for v in values) if least is not None else 0 if k == 0 else len(values)
        assert quality.top_k(df, k, "v", "t").where("kept").count() == want


def mixed(x):
    """splitmix64's finaliser."""
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
    x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
    return x ^ x >> 31


def grams(text):
    raw = text.encode()
    return [mixed(sum(raw[k + j] * 257 ** (3 - j) for j in range(4)) % 2**64) % quality.BUCKETS for k in range(len(raw) - 3)]


def test_as_brute_force(spark):
    """Models, weights, noise and the drawn rows, restated."""
    rows = [(i, t) for i, t in documents() if i is not None and i != 16] + [(100 + k, prose(50 + 7 * k, 40 + k)) for k in range(30)]
    labels = [(100 + k, k % 3 % 2, int(k == 3)) for k in range(24)]
    got = {r["doc_id"]: r for r in quality.classify(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    raw, target = Counter(), Counter()
    good = {i for i, q, t in labels if q == 1 and t == 0}
    for i, text in rows:
        found = grams(text or "")
        raw.update(found)
        target.update(found if i in good else ())
    n, m = raw.total() + quality.BUCKETS, target.total()

    def weight(text):
        p = [(raw[b] + 1) / n for b in grams(text or "")]
        extra = quality.SMOOTHING * m
        return sum(math.log((target[b] + extra * x) / (m + extra) / x) for b, x in zip(grams(text or ""), p, strict=True))

    noise = {r["i"]: r["g"] for r in spark.createDataFrame([(i,) for i, _ in rows], "i long").select("i", quality.gumbel("i").alias("g")).collect()}
    for i, text in rows:
        assert got[i]["n_grams"] == len(grams(text or "")) and abs(got[i]["log_weight"] - weight(text)) < 1e-5
        assert abs(got[i]["score"] - got[i]["log_weight"] - noise[i]) < 2e-6
    k = math.ceil(sum(q for _, q, _ in labels) / len(labels) * len(rows))
    best = sorted(rows, key=lambda r: -got[r[0]]["score"])[:k]
    assert {i for i, r in got.items() if r["kept"]} == {i for i, _ in best}


def test_separates_labelled_documents(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = quality.classify(docs, labels).join(labels, "doc_id")
    good, bad = got.where("quality = 1 AND toxic = 0"), got.where("quality = 0")
    assert good.where("kept").count() >= 0.97 * good.count()
    assert bad.where("kept").count() <= 0.2 * bad.count()


def test_odd_rows(spark):
    labels = spark.createDataFrame([(0, 1, 0), (0, 1, 0), (9, 1, None), (13, 0, 0), (None, 1, 0), (6, None, 1)], "doc_id long, quality int, toxic int")
    df = frame(spark)
    got = quality.classify(df, labels)
    assert got.count() == df.count()
    assert got.where("doc_id IN (3, 4)").agg(F.min("log_weight"), F.max("log_weight")).first() == (0.0, 0.0)
    assert quality.classify(df, labels.where("false")).where("NOT kept").count() == 0
    assert quality.classify(df.where("false"), labels).count() == 0
