import numpy as np
import pytest
from pyspark.sql import functions as F

from shardwise.llm import mixing
from shardwise.llm.queries import MIX, labelled_domains
from tests.llm.cases import frame

FOLDER = "/root/testdata/sf0.01"


def test_rates_meet_the_targets(spark):
    rng = np.random.default_rng(1)
    p = np.round(rng.dirichlet([1, 0.3, 0.3], 500), 3)
    t = rng.integers(1, 400, 500)
    member = spark.createDataFrame([(int(n), [float(y) for y in x]) for n, x in zip(t, p, strict=True)], "tokens long, p array<double>")
    step, residual = mixing.fit_rates(member, [0.6, 0.3, 0.1])
    assert residual <= 2e-6
    w = np.ones(500)
    w = np.maximum(0, w - p @ np.array(step))
    got = np.array([r[0] for r in member.select(mixing.rate(F.col("p"), step)).collect()])
    assert np.allclose(got, w, atol=1e-9) and (w >= 0).all()
    sums = (w * t) @ p
    assert np.allclose(sums / sums.sum(), [0.6, 0.3, 0.1], atol=1e-5)


@pytest.mark.parametrize("alpha", [[8, 1, 1], [1, 0.3, 0.3], [0.2, 0.05, 0.05]])
def test_overlapping_domains_meet_the_targets(spark, alpha):
    rng = np.random.default_rng(3)
    p = np.round(rng.dirichlet(alpha, 4000), 3)
    t = rng.integers(1, 400, 4000)
    member = spark.createDataFrame([(int(n), [float(y) for y in x]) for n, x in zip(t, p, strict=True)], "tokens long, p array<double>")
    w, want = np.ones(4000), np.array([0.9, 0.08, 0.02])
    w = np.maximum(0, w - p @ np.array(mixing.fit_rates(member, want.tolist())[0]))
    total = min((t @ p) / want)
    assert np.abs((w * t) @ p - total * want).max() <= 2e-6 * total


def test_targets_out_of_reach_give_least_squares(spark):
    member = spark.createDataFrame([(100, [0.5, 0.5]), (300, [0.5, 0.5])], "tokens long, p array<double>")
    w = max(0.0, 1.0 - 0.5 * sum(mixing.fit_rates(member, [0.9, 0.1], 300.0)[0]))
    assert abs(w - 0.75) <= 1e-4


def test_classifier_on_labelled_documents(spark):
    docs, labels = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")
    named = labels.select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").otherwise("low").alias("domain"))
    got = mixing.mix(docs, named, {"good": 0.9, "low": 0.08, "toxic": 0.02}).join(named, "doc_id")
    good = got.where("domain = 'good'")
    assert good.where("p[0] >= 0.5").count() >= 0.97 * good.count()
    total, shares = got.agg(F.sum(F.col("rate"))).first()[0], got.agg(F.min("rate")).first()[0]
    assert total > 0 and shares >= 0


def test_as_restated(spark):
    """Posteriors and rates of the whole query, restated in numpy from the fitted numbers; most posteriors differ, and the shares are the targets."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    named = labelled_domains(spark, FOLDER)
    c = mixing.fit(docs, named)
    got = sorted(mixing.mix(docs, named, MIX).collect(), key=lambda r: r["doc_id"])
    hashed = {r[0]: (r[1], set(r[2])) for r in docs.select("doc_id", F.size(mixing.words(F.col("text"))), mixing.features(mixing.words(F.col("text")))).collect()}
    known = list(c.slots.values())
    p = np.zeros((len(got), 3))
    for k, r in enumerate(got):
        there = [h for h in known if h in hashed[r["doc_id"]][1]]
        x = np.array([c.prior[d] + c.factor * (c.base[d] + sum(c.shift[d][h] for h in there)) if hashed[r["doc_id"]][0] else c.prior[d] for d in c.domains])
        p[k] = np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    assert np.abs(p - np.array([r["p"] for r in got])).max() < 1e-9
    t = np.array([hashed[r["doc_id"]][0] for r in got], dtype=float)
    want = np.array([MIX[d] for d in sorted(MIX)])
    want *= min((t @ p) / want)
    step = np.zeros(3)
    for _ in range(200):  # Newton steps on the same function, by numpy alone
        w = np.maximum(0, 1 - p @ step)
        step -= np.linalg.solve((p * (t * (w > 0))[:, None]).T @ p, want - (w * t) @ p)
    assert np.abs(np.array([r["rate"] for r in got]) - np.maximum(0, 1 - p @ step)).max() < 1e-4
    rates = np.array([r["rate"] for r in got])
    shares = (rates * t) @ p / (rates * t).sum()
    assert np.abs(shares - [MIX[d] for d in sorted(MIX)]).max() < 1e-5 and max(r["residual"] for r in got) < 1e-6
    assert len(np.unique(p.round(9), axis=0)) > 0.6 * len(got)


def test_anchor_and_draw(spark):
    """All tokens of the anchor are wanted, a domain that is short is wanted as it is, and a draw keeps what rates say."""
    rows = [(k, 100, [1.0, 0.0, 0.0]) for k in range(700)] + [(1000 + k, 100, [0.0, 1.0, 0.0]) for k in range(10)] + [(2000 + k, 100, [0.0, 0.0, 1.0]) for k in range(290)]
    member = spark.createDataFrame(rows, "doc_id long, tokens long, p array<double>")
    step, residual = mixing.fit_rates(member, [0.7, 0.2, 0.1], anchor=0)
    assert np.allclose(step, [0, 0, 1 - 100 / 290], atol=1e-5) and residual < 1e-6
    kept = mixing.drawn(member.withColumn("rate", mixing.rate(F.col("p"), step)))
    assert kept.where("doc_id < 2000").count() >= 709 and 70 <= kept.where("doc_id >= 2000").count() <= 130


def test_odd_rows(spark):
    df = frame(spark)
    labels = spark.createDataFrame([(0, "a"), (9, "b"), (9, "a"), (None, "a"), (77, "b"), (3, None)], "doc_id long, domain string")
    got = mixing.mix(df, labels, {"a": 0.5, "b": 0.5, "c": 0.0})
    assert got.count() == df.count() and got.where("rate < 0 OR rate IS NULL OR size(p) <> 3").count() == 0
    assert got.where("doc_id = 3").first()["tokens"] == 0
    assert mixing.mix(df, labels.where("false"), {"a": 1.0, "b": 1.0}).count() == df.count()
    assert mixing.mix(df.where("false"), labels, {"a": 1.0}).count() == 0


def test_no_python_in_the_plan(spark):
    df = frame(spark)
    labels = spark.createDataFrame([(0, "a"), (9, "b")], "doc_id long, domain string")
    plan = mixing.memberships(df, mixing.fit(df, labels), ["a", "b"])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
