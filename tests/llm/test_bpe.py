import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from shardwise.llm import bpe
from tests.llm.cases import documents, frame

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def encoder():
    with open(PATH, "rb") as f:
        return bpe.SpeculativeBPE(f.read())


def test_random_words_as_the_library(library, encoder):
    rng = random.Random(1)
    texts = ["".join(rng.choice(a) for _ in range(rng.randint(1, 40))) for a in ("abcdeilnorst", "aab", "a!'.0é ", "çéñü ", "<|endoftxsar>") for _ in range(400)]
    texts += ["abcdeinorst" * 900, "a" * 5001 + " " + "!" * 7000, "<|startoftext|>x<|endoftext|>"]
    codes, decoded = encoder.encode_texts(texts)
    for text, code, back in zip(texts, codes, decoded, strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(code, dtype=np.int32).tolist() == want
        assert back == library.decode(want, skip_special_tokens=False)
    assert encoder.repaired > 0


def test_proposals_that_pass_are_right(encoder):
    rng = random.Random(2)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(1, 14))).encode() for _ in range(3000)]
    raw = np.frombuffer(b"".join(words), dtype=np.uint8).astype(np.int64)
    bounds = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    exact = encoder.merge_exactly(raw, bounds)
    for got, want in zip(encoder.encode_words(words), exact, strict=True):
        assert got.tolist() == want.tolist()


def test_column(spark, library):
    got = {r["doc_id"]: (list(r["ids"]), r["decoded"]) for r in bpe.encode_column(frame(spark), PATH).collect()}
    for i, text in documents():
        want = library.encode(text or "", add_special_tokens=False).ids
        assert got[i] == (want, library.decode(want, skip_special_tokens=False))
    empty = bpe.digests(bpe.encode_column(frame(spark).where("false"), PATH))
    assert empty.count() == 0
