"""Secret scans: fixed base patterns, and formats learned by grammar inference.

Base spans are leftmost, non-overlapping matches of three fixed patterns. Their matched values are labelled
credentials: for each kind a bounded sample of those of at most LONGEST characters becomes a prefix tree over character classes, and states with
statistically compatible futures (Hoeffding's bound on each outgoing and ending frequency) are merged into a
probabilistic automaton. Every other token of a text that could be a credential, the rest of one that a base span
covers in part included, is then scored by its
mean log likelihood under each automaton, its end included; a token at least as likely as the least likely of
99 % of the sample, and RATIO times likelier than under the spread of all such tokens of the corpus (a chain over
pairs of character classes), is a span of kind `format`. Tokens are runs of the characters of base values of at least the least
base length, without dots at their ends.

Scale: both passes are per row; the sample is at most SAMPLE values a kind, picked by a hash of the value with
partial aggregation, so no value or kind gathers in one task; pairs of classes are counted over all rows. The automata (some kilobytes) go to the tasks.

Defined results: a null text counts as empty and has no spans; repeated rows give equal spans; texts of any length
are read whole; ties of a sample's hash go to the smaller value; an empty table gives an empty table, and
without base matches no format is learned. Only the named columns are read, so extra columns of any
name do no harm. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardwise.llm.bytetext import sliced

# The base patterns, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "format")
LEAST = {"assign": 8, "access": 16, "hex": 32}

#: Labelled credentials of each kind that automata are learned from, and how long those are at most; longer ones are scored, not learned from.
SAMPLE, LONGEST = 256, 512
#: Hoeffding confidence parameter of the merge test.
ALPHA = 0.05
LEAST_CANDIDATE = min(LEAST.values())
#: Letters, digits and marks that a candidate is made of.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % LEAST_CANDIDATE)
#: How many times likelier a candidate must be in a learned format than among all candidates.
RATIO = 1000.0
#: Verdicts on short candidates that a worker keeps.
MEMO, MEMO_CHARS = 1 << 17, 64

_CLASS = str.maketrans({c: k for k, cs in {"d": "0123456789", "h": "abcdef", "l": "ghijklmnopqrstuvwxyz", "A": "ABCDEF", "U": "GHIJKLMNOPQRSTUVWXYZ"}.items() for c in cs})


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) of all base matches. Long hex runs are matched at once: a run of hex digits is one match whatever its length."""
    found = [("assign", m.start(), m.end(), m.group(2)) for m in ASSIGN.finditer(text) if len(m.group(2)) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), m.group()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    found += [("hex", m.start(), m.end(), m.group()) for m in HEX.finditer(text)]
    return found


class Automaton:
    """A probabilistic automaton: `step[state][class]` is (next state, log probability), `stop[state]` the log probability to end there."""

    FLOOR = math.log(1e-4)

    def __init__(self, values: list[str]):
        self._infer([v.translate(_CLASS) for v in values])
        scores = sorted(self.score(v) for v in values)
        self.least = scores[len(scores) // 100] - 0.05

    def _infer(self, words: list[str]) -> None:
        children: list[dict[str, int]] = [{}]
        passing, ending = [0], [0]
        for w in words:
            state = 0
            passing[0] += 1
            for c in w:
                state = children[state].setdefault(c, len(children))
                if state == len(children):
                    children.append({})
                    passing.append(0)
                    ending.append(0)
                passing[state] += 1
            ending[state] += 1

        def differ(f1: int, n1: int, f2: int, n2: int) -> bool:
            return abs(f1 / n1 - f2 / n2) > math.sqrt(0.5 * math.log(2 / ALPHA)) * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

        def compatible(a: int, b: int) -> bool:
            todo = [(a, b)]
            while todo:
                a, b = todo.pop()
                if differ(ending[a], passing[a], ending[b], passing[b]):
                    return False
                for c in children[a].keys() | children[b].keys():
                    x, y = children[a].get(c), children[b].get(c)
                    if differ(passing[x] if x is not None else 0, passing[a], passing[y] if y is not None else 0, passing[b]):
                        return False
                    if x is not None and y is not None and x != y:
                        todo.append((x, y))
            return True

        def fold(red: int, blue: int) -> None:
            """Adds the tree below blue, which nothing else points to any more, to red."""
            todo = [(red, blue)]
            while todo:
                a, b = todo.pop()
                passing[a] += passing[b]
                ending[a] += ending[b]
                for c, y in children[b].items():
                    if c in children[a]:
                        todo.append((children[a][c], y))
                    else:
                        children[a][c] = y

        reds, parent = [0], {}
        blues = dict.fromkeys(children[0].values())
        parent.update({y: (0, c) for c, y in children[0].items()})
        while blues:
            blue = min(blues, key=lambda s: (-passing[s], s))
            del blues[blue]
            match = next((r for r in reds if compatible(r, blue)), None)
            if match is None:
                reds.append(blue)
            else:
                at, c = parent[blue]
                children[at][c] = match
                fold(match, blue)
            known = set(reds)
            blues = {}
            for r in reds:
                for c, y in children[r].items():
                    if y not in known and y not in blues:
                        blues[y], parent[y] = None, (r, c)
        traffic: dict[int, dict[str, int]] = defaultdict(lambda: defaultdict(int))
        stops: dict[int, int] = defaultdict(int)
        for w in words:
            state = 0
            for c in w:
                traffic[state][c] += 1
                state = children[state][c]
            stops[state] += 1
        self.step, self.stop = {}, {}
        for r in reds:
            total = sum(traffic[r].values()) + stops[r]
            self.step[r] = {c: (children[r][c], math.log(n / total)) for c, n in traffic[r].items()}
            self.stop[r] = math.log(stops[r] / total) if stops[r] else self.FLOOR

    def score(self, value: str) -> float:
        """Mean log likelihood of a value by character, its end included."""
        state, total = 0, 0.0
        for c in value.translate(_CLASS):
            known = self.step[state].get(c)
            if known is None:
                total += self.FLOOR
            else:
                state, p = known
                total += p
        return (total + self.stop[state]) / (len(value) + 1)


def candidates(text: str, taken: list[tuple[str, int, int, str]]) -> Iterator[tuple[int, int, str]]:
    """(start, end, value) of all tokens, or what base spans leave of them, of at least LEAST_CANDIDATE characters."""
    held = sorted((s, e) for _, s, e, _ in taken)
    k = 0
    for m in CANDIDATE.finditer(text):
        at, end = m.span()
        while k < len(held) and held[k][1] <= at:
            k += 1
        pieces, j = [], k
        while j < len(held) and held[j][0] < end:
            pieces.append((at, held[j][0]))
            at = max(at, held[j][1])
            j += 1
        for s, e in [*pieces, (at, end)]:
            while s < e and text[s] == ".":
                s += 1
            while s < e and text[e - 1] == ".":
                e -= 1
            if e - s >= LEAST_CANDIDATE:
                yield s, e, text[s:e]


def class_pairs(values: Counter) -> Counter:
    """How often each pair of classes occurs in the values; a blank stands for either end."""
    pairs: Counter = Counter()
    for value, n in values.items():
        word = f" {value.translate(_CLASS)} "
        for pair in zip(word, word[1:], strict=False):
            pairs[pair] += n
    return pairs


class Background:
    """The chain over classes that gives the pairs of all candidates of the corpus, each pair counted once more."""

    CLASSES = " dhlAU+/_.=-"

    def __init__(self, pairs: dict[tuple[str, str], int]):
        self.step = {}
        for a in self.CLASSES:
            total = sum(pairs.get((a, b), 0) + 1 for b in self.CLASSES)
            self.step |= {(a, b): math.log((pairs.get((a, b), 0) + 1) / total) for b in self.CLASSES}

    def score(self, value: str) -> float:
        """Mean log likelihood of a value by character, its end included."""
        word = f" {value.translate(_CLASS)} "
        return sum(self.step[pair] for pair in zip(word, word[1:], strict=False)) / (len(value) + 1)


class Formats:
    """The learned automata and the background of their tokens; false without any."""

    def __init__(self, automata: dict[str, Automaton], background: Background):
        self.automata, self.background, self.known = automata, background, {}

    def __bool__(self) -> bool:
        return bool(self.automata)

    def judge(self, value: str) -> bool:
        least = self.background.score(value) + math.log(RATIO) / (len(value) + 1)
        return any(x >= a.least and x >= least for a in self.automata.values() for x in (a.score(value),))

    def fits(self, value: str) -> bool:
        """Whether a value is of a learned format."""
        if len(value) > MEMO_CHARS:
            return self.judge(value)
        if value not in self.known:
            if len(self.known) >= MEMO:
                self.known.clear()
            self.known[value] = self.judge(value)
        return self.known[value]


def learned_spans(text: str, formats: Formats, taken: list[tuple[str, int, int, str]]) -> list[tuple[str, int, int, str]]:
    """Spans of kind `format`: candidates outside all base spans of a learned format."""
    return [("format", s, e, value) for s, e, value in candidates(text, taken) if formats.fits(value)]


def learn_formats(df: DataFrame, text_col: str = "text") -> Formats:
    """One automaton for each base kind that occurs in df, and the background of all its candidates."""

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text_col):
            rows, others = [], Counter()
            for t in batch.column(0).to_pylist():
                base = base_spans(t) if t else []
                rows += [(k, v, 1) for k, _, _, v in base if len(v) <= LONGEST]
                others.update(value for _, _, value in candidates(t or "", base))
            rows += [("", a + b, n) for (a, b), n in class_pairs(others).items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], names=["kind", "value", "n"])

    labelled = df.select(text_col).mapInArrow(values, "kind string, value string, n bigint").withColumn("order", F.xxhash64("value"))
    pair = F.ascii("value") * 256 + F.ascii(F.substring("value", 2, 1))
    slot = F.when(F.col("kind") == "", pair).otherwise(F.pmod("order", F.lit(SAMPLE)))
    picked = labelled.groupBy("kind", slot.alias("slot")).agg(F.min_by("value", F.struct("order", "value")).alias("value"), F.sum("n").alias("n"))
    by_kind: dict[str, list[str]] = defaultdict(list)
    pairs = {}
    for r in picked.orderBy("kind", "slot").collect():
        if r["kind"]:
            by_kind[r["kind"]].append(r["value"])
        else:
            pairs[tuple(r["value"])] = r["n"]
    return Formats({k: Automaton(v) for k, v in by_kind.items()}, Background(pairs))


SPAN = "array<struct<kind:string,start:int,end:int>>"


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", automata: Formats | None = None) -> DataFrame:
    """(id, spans array<struct<kind, start, end>>) of each row, by start, then kind as listed in KINDS."""
    shipped = df.sparkSession.sparkContext.broadcast(learn_formats(df, text_col) if automata is None else automata)
    order = {k: n for n, k in enumerate(KINDS)}
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text_col):
            spans = []
            for text in batch.column(1).to_pylist():
                base = base_spans(text) if text else []
                more = learned_spans(text, shipped.value, base) if text and shipped.value else []
                spans.append([{"kind": k, "start": s, "end": e} for k, s, e, _ in sorted(base + more, key=lambda x: (x[1], order[x[0]]))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], names=[id_col, "spans"])

    return df.select(id_col, text_col).mapInArrow(scan, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, spans {SPAN}")


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts by base kind, the digest of base spans, and all spans as one string."""

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        id_col,
        count("assign"),
        count("access"),
        count("hex"),
        F.sha2(listed(F.filter("spans", lambda s: s["kind"] != "format")).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def redact(df: DataFrame, text_col: str = "text", mark: str = "[secret]", automata: Formats | None = None) -> DataFrame:
    """df with each secret replaced by `mark`, overlapping spans as one; all columns stay and texts without secrets are unchanged."""
    shipped = df.sparkSession.sparkContext.broadcast(learn_formats(df, text_col) if automata is None else automata)
    place, kind = df.columns.index(text_col), pa.string()

    def clean(text: str | None) -> str | None:
        base = base_spans(text) if text else []
        spans = sorted((s, e) for _, s, e, _ in base + (learned_spans(text, shipped.value, base) if text and shipped.value else []))
        if not spans:
            return text
        out, at = [], 0
        for s, e in spans:
            if s >= at:
                out += [text[at:s], mark]
            at = max(at, e)
        return "".join([*out, text[at:]])

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text_col):
            yield batch.set_column(place, text_col, pa.array([clean(t) for t in batch.column(place).to_pylist()], kind))

    return df.mapInArrow(rewrite, df.schema)
