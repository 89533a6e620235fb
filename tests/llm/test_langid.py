import random

import pytest

from shardwise.llm import langid
from tests.llm.cases import frame


def parse(text, sample):
    """Greedy phrases of the whole text by definition."""
    known = ["".join(map(chr, langid.letters_and_blanks([t.lower()])[0])) for t in sample]
    text = "".join(map(chr, langid.letters_and_blanks([text.lower()])[0]))
    at = phrases = 0
    while at < len(text):
        n = 1
        while at + n < len(text) and any(text[at : at + n + 1] in k for k in known):
            n += 1
        phrases, at = phrases + 1, at + n
    return phrases


SAMPLES = {"xx": ["the quick brown fox jumps over the lazy dog", "and the quick cat"], "yy": ["der schnelle braune fuchs", "über den faulen hund"], "zz": ["ab" * 40 + " c " + "ab" * 3]}


@pytest.mark.parametrize("window", [1, 3, 7, 512])
@pytest.mark.parametrize("table", [0, 1 << 27])
def test_phrases_by_definition(monkeypatch, window, table):
    monkeypatch.setattr(langid, "WINDOW", window)
    monkeypatch.setattr(langid, "DENSE_BYTES", table)
    rng = random.Random(window)
    parser = langid.CrossParser(SAMPLES)
    texts = ["the quick cat jumps over the fox", "Der faule Hund!", "zzz 123 fuchs", "the lazy " * 200, "", "42", "ÿ", "ab" * 300 + "c" + "ab" * 30]
    texts += ["".join(rng.choice(["the", "quick ", "f", "uchs", "ab", "ab", " über", "x", "!"]) for _ in range(rng.randint(1, 90))) for _ in range(40)]
    bits, letters = parser.entropies(texts)
    for k, text in enumerate(texts):
        size = len(langid.letters_and_blanks([text.lower()])[0])
        for j, lang in enumerate(parser.languages):
            assert round(bits[k, j] * max(size, 1) / parser.bits) == parse(text, SAMPLES[lang])
        cut, some = parser.entropies([text], limit=5)
        assert cut[0].tolist() == bits[k].tolist() and some[0] == letters[k]
    langs, scores = parser.predict([*texts, None])
    assert langs[:3] == ["xx", "yy", "yy"] and langs[4] == langs[5] == langs[-1] == "und"
    assert all(0 <= s <= 1 for s in scores)


def test_samples(spark):
    """Letterless rows teach nothing, a one-word language wins only its own word, and text behind a long prefix is learned from."""
    letters = ["kato", "mire", "sul", "pend", "orva", "teks"]
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice(letters) for _ in range(200)), "aa") for k in range(40)]
    rows += [(100, "12 345 !!", "bb"), (101, "word", "cc"), (102, None, "dd"), (103, "x", None)]
    rows += [(104, "7 " * 5000 + "zwyx " * 5000, "ee")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    samples = langid.fit(df)
    assert set(samples) <= {"aa", "cc", "ee"} and {"aa", "cc"} <= set(samples)
    assert sum(map(len, samples["aa"])) <= langid.BUDGET + langid.PIECE
    parser = langid.CrossParser(samples)
    assert parser.predict(["kato mire sul pend orva", "word"])[0] == ["aa", "cc"]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs, langid.fit(docs.where(~langid.held_out()))).join(docs, "doc_id").where(langid.held_out())
    total, right = got.count(), got.where("lang = lang_pred").count()
    assert right >= 0.98 * total


def test_odd_rows(spark):
    df = frame(spark)
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(df, langid.fit(df)).collect()}
    assert got[3] == got[4] == got[5] == "und" and got[0] == "en"
    assert {r["lang_pred"] for r in langid.identify(df, {}).collect()} == {"und"}
    assert langid.identify(df.where("false"), langid.fit(df.where("false"))).count() == 0
