"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text knows every string that occurs in it. A text is parsed
greedily into phrases, each the longest match from where the last one ended (a symbol the language never has is
a phrase by itself). Phrases, times the bits of a position in the largest sample, by symbol is the cross-parsing
entropy; as all languages have one price, the one that needs the fewest phrases wins, and a small sample gains nothing by being
small. The score is how far the second lies behind, from 0 to 1.

Symbols are lower-cased letters; each run of other characters is one blank. A text is one parse from its first symbol to its last.
To advance many places at once in array operations, windows of WINDOW symbols are first parsed on their own; then each parse
that a border cuts is carried on into the next window until it begins a phrase where that window's own parse begins one,
from where both are the same. The result does not depend on WINDOW.

Scale: per row, no shuffle. Automata are built in each Python worker from the sample, about BUDGET symbols a language: some
megabytes of sorted transitions each. Rows are drawn by a hash of id and text, at a rate that follows from the language's
characters, and of each a piece of at most PIECE characters from anywhere in the text, so the driver gets a few times BUDGET a language. A text
longer than a slice is parsed in pieces that hand on their state.

Defined results: null text or text without a letter is `und` with score 0; languages that tie go by name; with one
language it wins with score 1; a language without a labelled row that has a letter is not learned; without any all is `und`; repeated
rows are judged alike; an empty table gives an empty table. Only the named columns are read, so extra columns of any name do no harm.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardwise.llm.bytetext import sliced

#: Bound of the labelled sample of each language, in characters, and of what is taken from one row.
BUDGET, PIECE = 1 << 15, 1 << 10
#: How many times BUDGET rows are drawn for, so that chance seldom leaves a language short.
SPARE = 2.0
#: Symbols that are parsed on their own first.
WINDOW = 512
#: Up to so many bytes all transitions are held in one table, which is faster; else in a sorted list alone. Results are the same.
DENSE_BYTES = 1 << 27
#: Bytes of text in a slice, times languages.
SLICE_BYTES = 8 << 20
UNDETERMINED = "und"

_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """For each code point whether it is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000))
    return _letters[0]


def letters_and_blanks(lowered: list[str], inside: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, runs of non-letters as one blank (32), none at a text's beginning; and the bounds of each text. `inside`: the first text goes on from a letter."""
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in lowered])]).astype(np.int64)
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = letter_table()[points]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    starts = bounds[:-1][bounds[:-1] < len(points)]
    keep[starts] = letter[starts]
    if inside and len(points):
        keep[0] = True
    kept = np.concatenate([[0], np.cumsum(keep)])
    return np.where(letter, points, 32)[keep], kept[bounds]


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton, state 0 first: a path exists exactly for the substrings."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                clone = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return step


class CrossParser:
    """Suffix automata of all languages; transitions are one sorted list of (state, symbol), and a table where that is small."""

    def __init__(self, samples: dict[str, list[str]]):
        self.languages = sorted(samples)
        parts = {lang: [letters_and_blanks([t.lower()])[0] for t in samples[lang]] for lang in self.languages}
        alphabet = sorted({int(c) for p in parts.values() for piece in p for c in np.unique(piece)} | {32})
        self.width = len(alphabet) + 2  # 0: a letter that no sample has; the last: a border between pieces, which no text has
        self.codes = np.zeros(0x110000, dtype=np.int32)
        self.codes[alphabet] = np.arange(1, self.width - 1)
        keys, targets, roots, base, most = [], [], [], 0, 0
        for lang in self.languages:
            sample = [c for piece in parts[lang] for c in (*self.codes[piece].tolist(), self.width - 1)]
            step = suffix_automaton(sample)
            edges = sorted(((base + s) * self.width + c, base + t) for s, out in enumerate(step) for c, t in out.items())
            keys += [k for k, _ in edges]
            targets += [t for _, t in edges]
            roots.append(base)
            base += len(step)
            most = max(most, len(sample))
        self.keys, self.targets, self.roots = np.array([*keys, np.iinfo(np.int64).max], dtype=np.int64), np.array([*targets, 0], dtype=np.int32), np.array(roots, dtype=np.int32)
        self.bits = math.log2(most + 2)
        #: A state's first transition, and whether it has more.
        self.at = np.searchsorted(self.keys, np.arange(base + 1, dtype=np.int64) * self.width)
        self.more = np.diff(self.at) > 1
        #: All transitions by state and symbol, where that table is small.
        self.dense = None
        if base * self.width * 4 <= DENSE_BYTES:
            self.dense = np.full(base * self.width, -1, dtype=np.int32)
            self.dense[self.keys[:-1]] = self.targets[:-1]
        #: From a language's root, the state after each symbol, or the root itself.
        self.first = np.repeat(self.roots[:, None], self.width, axis=1)
        for k, root in enumerate(roots):
            to = self._next(np.full(self.width, root), np.arange(self.width))
            self.first[k] = np.where(to < 0, root, to)

    def _next(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The state after a symbol, -1 where there is none."""
        wanted = state.astype(np.int64) * self.width + symbol
        first = self.at[state]
        found = self.keys[first] == wanted
        to = np.where(found, self.targets[first], -1)
        rest = np.flatnonzero(~found & self.more[state])  # most states have one transition and need no search
        others = np.searchsorted(self.keys, wanted[rest])
        to[rest] = np.where(self.keys[others] == wanted[rest], self.targets[others], -1)
        return to

    def _step(self, lang: np.ndarray, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after a symbol each, and whether it begins a phrase."""
        root, fresh = self.roots[lang], self.first[lang, symbol]
        begins = state == root
        if self.dense is not None:
            to = self.dense[state.astype(np.int64) * self.width + symbol]
            fails = to < 0
            return np.where(fails, fresh, to), begins | fails
        to = np.where(begins, fresh, 0)
        going = ~begins
        to[going] = self._next(state[going], symbol[going])
        fails = to < 0
        return np.where(fails, fresh, to), begins | fails

    def _alone(self, symbols: np.ndarray, start: np.ndarray, length: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each window parsed in each language from the given states (languages, windows): where phrases begin, and the states at the windows' ends."""
        begun = np.zeros((len(self.roots), len(symbols)), dtype=bool)
        order = np.argsort(-length, kind="stable")
        at, size = start[order], length[order]
        ends = state[:, order]
        lang = np.repeat(np.arange(len(self.roots))[:, None], len(order), axis=1)
        live = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), side="right")
        for t, n in enumerate(live.tolist()):
            ends[:, :n], begun[:, at[:n] + t] = self._step(lang[:, :n], ends[:, :n], np.broadcast_to(symbols[at[:n] + t], (len(lang), n)))
        out = np.empty_like(ends)
        out[:, order] = ends
        return begun, out

    def _carried(self, symbols: np.ndarray, begun: np.ndarray, lang: np.ndarray, start: np.ndarray, length: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Parses carried into windows until they meet the window's own: phrases begun before, the steps until then (length: never), and the state then."""
        extra, steps, state = np.zeros(len(lang), dtype=np.int64), length.copy(), state.copy()
        going = np.arange(len(lang))
        t = 0
        while len(going):
            place = start[going] + t
            after, begins = self._step(lang[going], state[going], symbols[place])
            met = begins & begun[lang[going], place]
            steps[going[met]] = t
            extra[going[begins & ~met]] += 1
            state[going] = after
            t += 1
            going = going[~met & (length[going] > t)]
        return extra, steps, state

    def parse(self, lowered: list[str], state: np.ndarray | None = None, inside: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Phrases of each text (rows) in each language, numbers of symbols and letters, and the states after the last text. `state` and `inside` tell how the first text goes on from an earlier piece."""
        points, bounds = letters_and_blanks(lowered, inside)
        letters = np.diff(np.concatenate([[0], np.cumsum(points != 32)])[bounds])
        sizes = np.diff(bounds)
        windows = -(-sizes // WINDOW)
        owner = np.repeat(np.arange(len(lowered)), windows)
        nth = np.arange(len(owner)) - np.repeat(np.concatenate([[0], np.cumsum(windows)])[:-1], windows)
        start = bounds[owner] + nth * WINDOW
        length = np.minimum(bounds[owner + 1] - start, WINDOW)
        symbols = self.codes[points].astype(np.int64)
        first = np.repeat(self.roots[:, None], len(owner), axis=1)
        if state is not None and len(owner) and owner[0] == 0:
            first[:, 0] = state
        begun, ends = self._alone(symbols, start, length, first)
        before = np.concatenate([np.zeros((len(self.roots), 1), dtype=np.int64), np.cumsum(begun, axis=1)], axis=1)
        counts = before[:, start + length] - before[:, start]
        alone = ends.copy()
        lang, at = np.nonzero((nth[1:] > 0) & (ends[:, :-1] != self.roots[:, None])) if len(owner) else (np.zeros(0, int), np.zeros(0, int))
        while len(lang):
            at = at + 1
            extra, steps, after = self._carried(symbols, begun, lang, start[at], length[at], ends[lang, at - 1])
            met = steps < length[at]
            counts[lang, at] = extra + before[lang, start[at] + length[at]] - before[lang, start[at] + steps]
            new = np.where(met, alone[lang, at], after)
            changed = (new != ends[lang, at]) & (np.append(nth, 0)[at + 1] > 0)
            ends[lang, at] = new
            lang, at = lang[changed], at[changed]
        phrases = np.stack([np.bincount(owner, weights=c, minlength=len(lowered)) for c in counts], 1)
        last = ends[:, -1] if len(owner) and sizes[-1] else (self.roots if state is None else state)
        return phrases, sizes, letters, last

    def entropies(self, texts: list[str], limit: int = SLICE_BYTES) -> tuple[np.ndarray, np.ndarray]:
        """Bits by symbol of each text (rows) in each language, and each text's number of letters."""
        lowered = [t.lower() for t in texts]
        if len(lowered) == 1 and len(lowered[0]) > limit:
            whole, state, inside = lowered[0], None, False
            phrases, sizes, letters = np.zeros((1, len(self.roots))), np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
            for k in range(0, len(whole), limit):
                more, size, some, state = self.parse([whole[k : k + limit]], state, inside)
                phrases, sizes, letters = phrases + more, sizes + size, letters + some
                inside = bool(letter_table()[ord(whole[min(k + limit, len(whole)) - 1])])
        else:
            phrases, sizes, letters, _ = self.parse(lowered)
        return phrases * self.bits / np.maximum(sizes, 1)[:, None], letters

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if not self.languages:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts)
        bits, letters = self.entropies([t or "" for t in texts], self.slice_bytes())
        best = bits.argmin(1)
        ranked = np.sort(bits, 1)
        score = np.ones(len(texts)) if len(self.languages) == 1 else 1 - ranked[:, 0] / np.maximum(ranked[:, 1], 1e-12)
        known = letters > 0
        return [self.languages[b] if k else UNDETERMINED for b, k in zip(best, known, strict=True)], np.where(known, np.round(score, 6), 0.0).tolist()

    def slice_bytes(self) -> int:
        """Bytes of text to be parsed together, such that what is kept by symbol and language stays small."""
        return max(1 << 14, SLICE_BYTES // max(4, len(self.languages)))


_parsers: dict[int, CrossParser] = {}


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, list[str]]:
    """Pieces of labelled texts of each language, of about BUDGET characters together."""
    known = df.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike("\\p{L}"))
    rows = known.select(F.col(lang_col).alias("lang"), F.xxhash64(id_col, text_col).alias("order"), F.col(text_col).alias("text"), F.length(text_col).alias("size"))
    totals = rows.groupBy("lang").agg(F.sum(F.least("size", F.lit(PIECE))).alias("chars")).collect()
    if not totals:
        return {}
    span = 1 << 30
    rates = df.sparkSession.createDataFrame([(r["lang"], min(span, math.ceil(SPARE * BUDGET / r["chars"] * span))) for r in totals], "lang string, below long")
    drawn = rows.join(F.broadcast(rates), "lang").where(F.pmod("order", F.lit(span)) < F.col("below"))  # a number for each language
    place = F.pmod(F.xxhash64("order"), F.greatest(F.col("size") - PIECE, F.lit(0)) + 1).cast("int") + 1
    pieces = drawn.select("lang", "order", F.col("text").substr(place, F.lit(PIECE)).alias("piece")).distinct().collect()
    samples: dict[str, list[str]] = {}
    taken: dict[str, int] = {}
    for r in sorted(pieces, key=lambda r: (r["lang"], r["order"], r["piece"])):
        if taken.get(r["lang"], 0) < BUDGET and any(c.isalpha() for c in r["piece"]):
            samples.setdefault(r["lang"], []).append(r["piece"])
            taken[r["lang"]] = taken.get(r["lang"], 0) + len(r["piece"])
    return samples


def identify(df: DataFrame, samples: dict[str, list[str]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of each row of df by the automata of the samples."""
    shipped = df.sparkSession.sparkContext.broadcast(samples)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(repr(shipped.value))
        if key not in _parsers:
            _parsers.clear()
            _parsers[key] = CrossParser(shipped.value)
        for batch in sliced(batches, text_col, _parsers[key].slice_bytes()):
            langs, scores = _parsers[key].predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[id_col, "lang_pred", "score"])

    return df.select(id_col, text_col).mapInArrow(judge, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, lang_pred string, score double")


def held_out(id_col: str = "doc_id", folds: int = 3, fold: int = 1) -> Column:
    """Whether the checksum of the id as text falls in the held-out fold; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))
