import random
import re
from collections import defaultdict

from shardwise.llm import near_dup
from shardwise.llm.graph import connected_components
from tests.llm.cases import documents, frame, prose


def brute(rows, words, percent):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets.append({tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                up[find(a)] = find(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)].append(i)
    return sorted(((i, len(sets[k]), min(least[find(k)]) if sets[k] and least[find(k)] else i) for k, (i, _) in enumerate(rows)), key=str)


def found(df, words, percent):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(df, words, percent).collect()), key=str)


def chained(n):
    rng, words, rows = random.Random(5), prose(150, 9).split(" "), []
    for k in range(n):
        for _ in range(3):
            words[rng.randrange(len(words))] = f"w{rng.randrange(50)}"
        rows.append((100 + k, " ".join(words)))
    return rows


def test_small_cases(spark):
    for words, percent in ((3, 85), (5, 80)):
        assert found(frame(spark), words, percent) == brute(documents(), words, percent)
    assert near_dup.near_duplicates(frame(spark).where("false")).count() == 0


def test_large_components_in_blocks_and_hot_keys(spark, monkeypatch):
    rows = documents() + chained(60)
    monkeypatch.setattr(near_dup, "BLOCK", 8)
    assert found(frame(spark, rows), 3, 85) == brute(rows, 3, 85)
    monkeypatch.setattr(near_dup, "HOT", 4)
    assert found(frame(spark, rows), 3, 85) == brute(rows, 3, 85)


def test_null_ids_link(spark):
    """A row without an id between two others, a pair of rows without ids, and a repeated row."""
    base = prose(200, 21).split(" ")

    def edited(*at):
        return " ".join("edit" if k in at else w for k, w in enumerate(base))

    rows = [(1, edited(10, 20, 30, 40, 50)), (None, edited()), (3, edited(100, 110, 120, 130, 140)), (None, prose(90, 22)), (None, prose(90, 22)), *[(9, prose(80, 23))] * 5, (8, prose(80, 23) + " more")]
    assert found(frame(spark, rows), 3, 85) == brute(rows, 3, 85)
    got = near_dup.near_duplicates(frame(spark, rows), 3, 85).collect()
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in got} == {(1, 1, True), (3, 1, False), (None, 1, False), (None, None, True), (8, 8, True), (9, 8, False)}


def test_clusters_of_a_component_are_compared(spark, monkeypatch):
    """Two large clusters and some single classes in one candidate component: only links across clusters are left to the second pass."""
    monkeypatch.setattr(near_dup, "BLOCK", 4)
    rng, rows = random.Random(8), []
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    for c in range(3):
        own = list(base)
        for k in range(c * 8):
            own[k * 6 + 2] = f"c{c}x{k}"
        for k in range(14):
            words = list(own)
            words[rng.randrange(200)] = f"e{k}"
            rows.append((100 * c + k, " ".join(words)))
    for k in range(6):
        words = list(base)
        for _ in range(9 + k):
            words[rng.randrange(200)] = f"s{k}"
        rows.append((900 + k, " ".join(words)))
    rng.shuffle(rows)
    called = []
    monkeypatch.setattr(near_dup, "pairs_of_blocks", lambda df, make=near_dup.pairs_of_blocks: called.append(1) or make(df))
    assert found(frame(spark, rows), 3, 85) == brute(rows, 3, 85)
    assert called


def test_keys_cover_the_distance():
    import numpy as np

    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 16, near_dup.COMPONENTS).astype(np.uint16)
    for _ in range(200):
        b = a.copy()
        at = rng.choice(near_dup.COMPONENTS, near_dup.DISTANCE, replace=False)
        b[at] ^= 1
        ka, kb = near_dup.chunk_keys(np.stack([a, b]))
        assert (ka == kb).any()


def test_pair_with_many_different_values(spark):
    """36 of 44 shingles in common, and 20 of 50 values of the signatures different."""
    common = " ".join(f"s5327x{k}" for k in range(40))
    rows = [(k, common + "".join(f" {c}5327x{j}" for j in js)) for k, (c, js) in enumerate([("s", range(40, 44)), ("t", range(4))])]
    assert found(frame(spark, rows), 5, 80) == brute(rows, 5, 80) == [(0, 40, 0), (1, 40, 0)]


def test_miss_rates():
    for percent, most in ((50, 400), (70, 100), (80, 50), (85, 50), (100, 50)):
        components, distance = near_dup.allowed(percent)
        assert components <= most and near_dup.miss_rate(percent, components, distance) < 1e-5


def test_components(spark):
    edges = [(k, k + 1) for k in range(30)] + [(100, 101), (101, 100), (7, 7), (200, 5)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{k: 0 for k in range(31)}, 200: 0, 100: 100, 101: 100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
