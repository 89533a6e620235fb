import random

from shardwise.llm import hamming


def brute(rows, asked, k):
    code = {i: [x is not None and x > 0 for x in v] for i, v in rows if i is not None and v is not None and len(v) == 64}
    out = set()
    for q in asked:
        if q in code:
            near = sorted((sum(a != b for a, b in zip(code[q], c, strict=True)), i) for i, c in code.items())[:k]
            out |= {(q, n, i, d) for n, (d, i) in enumerate(near, 1)}
    return out


def test_as_brute_force(spark):
    rng = random.Random(3)
    centers = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(5)]
    rows = [(i, [c + rng.gauss(0, 0.4) for c in rng.choice(centers)]) for i in range(300)]
    rows += [(300 + k, rows[7][1]) for k in range(40)]  # one code many times
    rows += [(400, None), (401, [1.0] * 10), (402, [None] * 64), (403, [])]
    df = spark.createDataFrame([(i, v, i, "x") for i, v in rows], "vec_id long, embedding array<float>, rank long, query string")
    got = {tuple(r) for r in hamming.search(df, df.where("vec_id % 50 = 0"), k=7).collect()}
    assert got == brute(rows, [i for i, _ in rows if i % 50 == 0], 7)


def test_fewer_rows_than_k_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0] * 64), (1, [-1.0] * 64)], "vec_id long, embedding array<float>")
    assert {tuple(r) for r in hamming.search(df, df.where("vec_id = 0"), k=5).collect()} == {(0, 1, 0, 0), (0, 2, 1, 64)}
    assert hamming.search(df.where("false"), df.where("false"), k=5).count() == 0


def test_rounds_broadcast_nothing(spark, monkeypatch):
    """A query far from all others takes the radius to 8, whose 12,870 masks a segment value must not be sent to every task whole."""
    plans, written = [], hamming.Tables.written

    def noted(self, df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(self, df)

    monkeypatch.setattr(hamming.Tables, "written", noted)
    rows = [(0, [-1.0] * 64)] + [(i, [1.0 if b % 16 >= 8 - i % 2 else -1.0 for b in range(64)]) for i in range(1, 30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {tuple(r) for r in hamming.search(df, df.where("vec_id = 0"), k=5).collect()}
    assert got == brute(rows, [0], 5)
    assert len(plans) > 16 and not any("Broadcast" in p for p in plans)
