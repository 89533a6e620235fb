"""Small tables with the cases that every operator has to handle."""

import random

rng = random.Random(7)


def prose(n: int, seed: int, vocabulary: int = 400) -> str:
    r = random.Random(seed)
    words = ["".join(random.Random(w).choice("abcdeghilmnoprstu") for _ in range(2 + w % 7)) for w in range(vocabulary)]
    return " ".join(r.choice(words) + r.choice(["", "", "", ",", ".", "\n"]) for _ in range(n))


def documents() -> list[tuple]:
    base = prose(300, 1)
    other = base.split(" ")
    other[150] = "changed"
    long_text = prose(6000, 2)
    passage = prose(120, 3)
    rows = [
        (0, base),
        (1, base),
        (2, " ".join(other)),
        (3, None),
        (4, ""),
        (5, " \n\t "),
        (6, "one"),
        (7, "One"),
        (8, "one two"),
        (9, long_text),
        (10, prose(80, 4) + passage + prose(80, 5)),
        (11, prose(90, 6) + passage + prose(70, 7)),
        (12, "Größe naïve ΑΣ 東京 <|endoftext|> it's 'll 2026!! " + prose(30, 8)),
        (13, "a" * 1500),
        (14, passage),
        (15, "x" * 450 + "y" * 450 + "x" * 450),
        (None, base[:700]),
        (16, base),
        (16, base),
        (17, long_text[:9000] + " different " + long_text[9000:]),
    ]
    return rows


def frame(spark, rows=None):
    """The documents with more columns, named like those that operators make themselves."""
    rows = documents() if rows is None else rows
    made = [(i, t, "en" if k % 3 else None, f"src{k % 2}", None if t is None else len(t), k, "clash", 1.5, "clash") for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long, id long, key string, score double, spans string")
