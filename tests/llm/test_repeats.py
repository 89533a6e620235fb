import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shardwise.llm import repeats
from shardwise.llm.storage import gathered
from shardwise.llm.suffixes import suffix_array
from tests.llm.cases import documents, frame, prose


def brute(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    count = Counter(t[k : k + length] for t in texts for k in range(len(t) - length + 1))
    out = []
    for (i, _), t in zip(rows, texts, strict=True):
        gone = [False] * len(t)
        for k in range(len(t) - length + 1):
            if count[t[k : k + length]] > 1:
                gone[k : k + length] = [True] * length
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((i, len(t), sum(gone), sum(g and (not k or not gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest(), len(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [4000, 1])
def test_as_brute_force(spark, hot):
    got = repeats.digests(repeats.remove_repeats(frame(spark), hot=hot)).collect()
    assert sorted(map(tuple, got), key=str) == brute(documents(), 400)


def test_equal_parts_are_compared_once(spark, monkeypatch):
    """A passage in more than `hot` documents with other text around it, and one copy with an edit that makes its parts' keys mixed."""
    passage = prose(150, 3)
    rows = [(k, prose(60, 100 + k) + passage + prose(60, 200 + k)) for k in range(14)] + [(50 + k, prose(60, 300 + k) + passage[: 420 + 9 * k] + "#" + passage[421 + 9 * k :]) for k in range(3)]
    given, compare = [], repeats.compare

    def counted(segments, length):
        given.append(segments.groupBy("key").agg(F.count("*").alias("rows"), F.count_distinct("content").alias("contents")).collect())
        return compare(segments, length)

    monkeypatch.setattr(repeats, "compare", counted)
    got = repeats.digests(repeats.remove_repeats(frame(spark, rows), hot=6)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 400)
    assert any(given[1:]) and all(r["rows"] == r["contents"] <= 6 for g in given for r in g)


def test_long_texts_are_cut(spark, monkeypatch):
    """Windows that cross the border of two pieces are found like others."""
    monkeypatch.setattr(repeats, "SLICE_BYTES", 1000)
    shared = prose(120, 5)
    rows = [(1, prose(400, 6) + shared + prose(300, 7)), (2, shared), (3, prose(250, 8) + shared[:450] + prose(20, 9)), (4, None), (5, prose(700, 10))]
    got = repeats.digests(repeats.remove_repeats(frame(spark, rows))).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 400)


def test_groups_are_not_parted(spark):
    """A repartition by the keys of a join below is kept, so that adaptive execution cannot part rows of equal keys."""
    a, b = (spark.range(100).select((F.col("id") % 7).alias("key"), F.col("id").alias(n)) for n in "ab")
    plan = gathered(a.hint("merge").join(b, "key"), "key", partitions=4).mapInArrow(lambda x: x, "key bigint, a bigint, b bigint")._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan


def test_neighbours_are_compared_as_bytes(monkeypatch):
    monkeypatch.setattr(repeats, "range_hash", lambda prefix, start, end: start * 0)
    raw = np.frombuffer(b"abcabcab", dtype=np.uint8)
    assert repeats.equal_neighbours(raw, np.array([0, 3, 1, 4, 2]), 4).tolist() == [True, False, True, False]


def test_empty(spark):
    assert repeats.remove_repeats(frame(spark).where("false")).count() == 0


def test_suffix_arrays():
    rng = random.Random(4)
    for _ in range(500):
        s = [rng.randint(1, rng.choice([1, 2, 5])) for _ in range(rng.randint(0, 50))] + [0]
        assert suffix_array(s) == sorted(range(len(s)), key=lambda i, s=s: s[i:])
