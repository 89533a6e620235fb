"""BPE encoding and decoding by speculation and verification.

A greedy longest match proposes the tokens of each distinct word. A proposal is the true BPE
result exactly if no merge would ever cross one of its token borders, which depends on each
adjacent pair of tokens alone; so all adjacent pairs of all proposed words are tested together
with array operations, and only words with a failing pair are merged exactly, step by step.

Why pairs suffice: merges inside the two tokens of a pair happen at the ranks that built them.
Undoing those merges, latest first, shows which two symbols met at the border and for how long;
the border holds if no merge rule for the two symbols then facing each other would have run
earlier than the next merge that consumes one of them. With equal ranks the left place goes first.

Defined results: a null text counts as empty; an empty text, or one of white space, has no tokens
and decodes to the empty string; repeated rows and ties are encoded alike; an empty table gives an
empty table; only the named id and text columns are read, so extra columns of any name do no harm.
Texts of any length are encoded whole; memory holds a few megabytes of text at a time.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardwise.llm.bytetext import sliced

#: Words whose encodings a Python worker keeps; beyond that its store starts afresh.
KEPT_WORDS = 300_000

#: Bytes from which a failing word is merged by itself.
LONG_WORD = 2048

_NO_RANK = np.int64(1) << 20
_PLACE_BITS = 40

# The word pattern of the vocabulary file's own pre-tokenizer.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|{letter}+|{number}|[^{space}{letters}{numbers}]+"


def byte_alphabet() -> dict[int, str]:
    """The printable stand-ins of byte-level BPE: printable Latin-1 bytes stand for themselves, the others get code points from 256 on in order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class _Lookup:
    """A read-only map from whole numbers to whole numbers for arrays of keys: open addressing with linear probing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(8, int(4 * len(keys)).bit_length())
        size = 1 << self.bits
        self.keys, self.values = np.full(size, -1, dtype=np.int64), np.zeros(size, dtype=np.int64)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[slot] < 0
            _, first = np.unique(np.where(free, slot, -1 - np.arange(len(slot))), return_index=True)
            first = first[free[first]]
            self.keys[slot[first]], self.values[slot[first]] = keys[left[first]], values[left[first]]
            rest = np.ones(len(left), dtype=bool)
            rest[first] = False
            left, slot = left[rest], (slot[rest] + ~free[rest]) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray, default: int) -> np.ndarray:
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.values[slot], default)
        at = np.flatnonzero((there != keys) & (there >= 0))
        while len(at):
            slot[at] = (slot[at] + 1) & (len(self.keys) - 1)
            there = self.keys[slot[at]]
            same = there == keys[at]
            out[at[same]] = self.values[slot[at[same]]]
            at = at[~same & (there >= 0)]
        return out


class SpeculativeBPE:
    """One vocabulary file's encoder; use `encode_words` for distinct words and `encode_texts` for whole texts."""

    def __init__(self, content: bytes):
        spec = json.loads(content)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        vocab: dict[str, int] = model["vocab"]
        self.specials = {a["content"]: a["id"] for a in spec["added_tokens"]}
        size = max([*vocab.values(), *self.specials.values()]) + 1
        self.strings = np.array([""] * size, dtype=object)
        for s, i in [*vocab.items(), *self.specials.items()]:
            self.strings[i] = s
        pairs = [m if isinstance(m, list) else m.split(" ", 1) for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.size = size
        self.rank = np.full(size, -1, dtype=np.int64)
        self.left, self.right = np.full(size, -1, dtype=np.int64), np.full(size, -1, dtype=np.int64)
        self.rank[made], self.left[made], self.right[made] = np.arange(len(made)), left, right
        keys = left * size + right
        self._rules, self._made = _Lookup(keys, np.arange(len(made))), made
        sound = np.zeros(size, dtype=bool)
        sound[self.rank < 0] = True
        fits = self.compatible(left, right, np.arange(len(made)))
        for a, b, c, ok in zip(left.tolist(), right.tolist(), made.tolist(), fits.tolist(), strict=True):
            sound[c] = ok and sound[a] and sound[b]
        self.vocab = vocab
        byte_of = {c: b for b, c in byte_alphabet().items()}
        self._first_inner, self._first_final = np.full(256, -1, dtype=np.int64), np.full(256, -1, dtype=np.int64)
        children: dict[tuple[int, int], int] = {}
        inner, final = [-1], [-1]
        for s, i in vocab.items():
            ends = bool(self.suffix) and s.endswith(self.suffix)
            spelled = [byte_of[c] for c in (s[: -len(self.suffix)] if ends else s)]
            if len(spelled) == 1:
                (self._first_final if ends else self._first_inner)[spelled[0]] = i
            if sound[i]:
                node = 0
                for c in spelled:
                    node = children.setdefault((node, c), len(inner))
                    if node == len(inner):
                        inner.append(-1)
                        final.append(-1)
                (final if ends else inner)[node] = i
        if not self.suffix:
            final, self._first_final = inner, self._first_inner
        self._inner, self._final = np.array(inner, dtype=np.int64), np.array(final, dtype=np.int64)
        self._trie = _Lookup(np.array([n * 256 + c for n, c in children], dtype=np.int64), np.array([*children.values()], dtype=np.int64))
        self._special_pattern = re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        self._ids: dict[str, bytes] = {}
        self._texts: dict[str, str] = {}
        self.repaired = 0

    def compatible(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether no merge crosses the border of each pair of tokens (a, b), considering only ranks below `limit` if given."""
        a, b = a.astype(np.int64), b.astype(np.int64)
        limit = np.full(len(a), _NO_RANK) if limit is None else limit.astype(np.int64)
        good = np.ones(len(a), dtype=bool)
        at = np.arange(len(a))
        while len(at):
            keys = a * self.size + b
            crossing = self._rules.get(keys, _NO_RANK)
            bad = crossing < limit
            good[at[bad]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~bad & ((ra >= 0) | (rb >= 0))
            undo_left = ra > rb
            limit = np.where(undo_left, ra, rb + 1)
            a, b = np.where(undo_left, self.right[a], a), np.where(undo_left, b, self.left[b])
            at, a, b, limit = at[go], a[go], b[go], limit[go]
        return good

    def propose(self, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match of all words at once: the proposed ids in one array, and their bounds by word. -1 stands for a byte in no token."""
        at, end = bounds[:-1].copy(), bounds[1:]
        word = np.flatnonzero(at < end)
        found_word, found_at, found_id = [], [], []
        while len(word):
            walker, cursor, node = np.arange(len(word)), at[word], np.zeros(len(word), dtype=np.int64)
            best, best_end = np.full(len(word), -1, dtype=np.int64), at[word] + 1
            stop = end[word]
            while len(walker):
                node = self._trie.get(node * 256 + raw[cursor], -1)
                go = node >= 0
                walker, cursor, node = walker[go], cursor[go] + 1, node[go]
                last = cursor == stop[walker]
                token = np.where(last, self._final[node], self._inner[node])
                hit = token >= 0
                best[walker[hit]], best_end[walker[hit]] = token[hit], cursor[hit]
                walker, cursor, node = walker[~last], cursor[~last], node[~last]
            found_word.append(word)
            found_at.append(at[word])
            found_id.append(best)
            at[word] = best_end
            word = word[best_end < stop]
        if not found_word:
            return np.zeros(0, dtype=np.int64), np.zeros(len(bounds), dtype=np.int64)
        words, starts, ids = map(np.concatenate, (found_word, found_at, found_id))
        ids = ids[np.argsort(starts, kind="stable")]
        return ids, np.concatenate([[0], np.cumsum(np.bincount(words, minlength=len(bounds) - 1))])

    def merge_exactly(self, raw: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
        """The definition, for many words at once: in each round every word merges its leftmost pair of least rank, until no rule fits. Symbols without an id vanish."""
        ids = self._first_inner[raw]
        full = bounds[1:] > bounds[:-1]
        ids[bounds[1:][full] - 1] = self._first_final[raw[bounds[1:][full] - 1]]
        owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        ids, owner = ids[ids >= 0], owner[ids >= 0]
        out: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * (len(bounds) - 1)
        ranks = self._pair_ranks(ids, owner)
        while len(ids):
            starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            least = np.minimum.reduceat((ranks << _PLACE_BITS) + np.arange(len(ids)), starts)  # by rank, then by place
            live = least >> _PLACE_BITS < _NO_RANK
            if not live.all():
                sizes = np.diff(np.append(starts, len(ids)))
                for k in np.flatnonzero(~live):
                    out[owner[starts[k]]] = ids[starts[k] : starts[k] + sizes[k]]
                stay = np.repeat(live, sizes)
                ids, owner, ranks = ids[stay], owner[stay], ranks[stay]
                if not len(ids):
                    break
                starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
                least = np.minimum.reduceat((ranks << _PLACE_BITS) + np.arange(len(ids)), starts)
            place = least & ((1 << _PLACE_BITS) - 1)
            ids[place] = self._made[least >> _PLACE_BITS]
            keep = np.ones(len(ids), dtype=bool)
            keep[place + 1] = False
            moved = place - np.arange(len(place))
            ids, owner, ranks = ids[keep], owner[keep], ranks[keep]
            touched = np.unique(np.concatenate([moved, np.maximum(moved - 1, 0)]))
            ranks[touched] = self._pair_ranks(ids, owner, touched)
        return out

    def merge_long(self, raw: np.ndarray) -> np.ndarray:
        """The same for one very long word, with a heap of pairs over a linked list, so that time stays near linear."""
        ids = self._first_inner[raw]
        ids[-1] = self._first_final[raw[-1]]
        ids = ids[ids >= 0].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks = self._pair_ranks(np.array(ids, dtype=np.int64), np.zeros(n, dtype=np.int64)).tolist() if n else []
        heap = [(r, k, ids[k], ids[k + 1]) for k, r in enumerate(ranks) if r < _NO_RANK]
        heapq.heapify(heap)
        while heap:
            r, k, a, b = heapq.heappop(heap)
            j = after[k]
            if ids[k] != a or j >= n or ids[j] != b:
                continue
            ids[k], ids[j] = int(self._made[r]), -1
            after[k] = after[j]
            if after[k] < n:
                before[after[k]] = k
            for x in (before[k], k):
                if x >= 0 and after[x] < n:
                    r = int(self._rules.get(np.array([ids[x] * self.size + ids[after[x]]]), _NO_RANK)[0])
                    if r < _NO_RANK:
                        heapq.heappush(heap, (r, x, ids[x], ids[after[x]]))
        return np.array([i for i in ids if i >= 0], dtype=np.int64)

    def _pair_ranks(self, ids: np.ndarray, owner: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        """The rank of each symbol with the next one of its word."""
        at = np.arange(len(ids)) if at is None else at
        after = np.minimum(at + 1, len(ids) - 1)
        ranks = self._rules.get(ids[at] * self.size + ids[after], _NO_RANK)
        ranks[(after == at) | (owner[after] != owner[at])] = _NO_RANK
        return ranks

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word, given in UTF-8: proposals, one joint test of all adjacent pairs, repairs."""
        raw = np.frombuffer(b"".join(words), dtype=np.uint8).astype(np.int64)
        bounds = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
        ids, at = self.propose(raw, bounds)
        owner = np.repeat(np.arange(len(words)), np.diff(at))
        failing = np.zeros(len(words), dtype=bool)
        failing[owner[ids < 0]] = True
        if len(ids) > 1:
            inner = owner[1:] == owner[:-1]
            left, right, where = ids[:-1][inner], ids[1:][inner], owner[1:][inner]
            keys, back = np.unique(left * self.size + right, return_inverse=True)
            failing[where[~self.compatible(keys // self.size, keys % self.size)[back]]] = True
        out = np.split(ids, at[1:-1])
        lengths = np.diff(bounds)
        for k in np.flatnonzero(failing & (lengths > LONG_WORD)):
            out[k] = self.merge_long(raw[bounds[k] : bounds[k + 1]])
        broken = np.flatnonzero(failing & (lengths <= LONG_WORD))
        if len(broken):
            sizes = bounds[broken + 1] - bounds[broken]
            local = np.concatenate([[0], np.cumsum(sizes)])
            take = np.repeat(bounds[broken] - local[:-1], sizes) + np.arange(local[-1])
            for k, fixed in zip(broken, self.merge_exactly(raw[take], local), strict=True):
                out[k] = fixed
        self.repaired += int(failing.sum())
        return out

    def split(self, text: str) -> list[str]:
        """Words of a text without special tokens: normalised, lower-cased, in characters."""
        if text.isascii():
            return _ascii_words(text.lower())
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return _any_words(text)

    def _learn(self, words: set[str]) -> None:
        if len(self._ids) + len(words) > KEPT_WORDS:
            self._ids.clear()
            self._texts.clear()
        new = [w for w in words if w not in self._ids]
        encoded = self.encode_words([w.encode() for w in new])
        flat = np.concatenate(encoded) if encoded else np.zeros(0, dtype=np.int64)
        codes, strings, at = flat.astype(np.int32).tobytes(), self.strings[flat].tolist(), 0
        for w, ids in zip(new, encoded, strict=True):
            self._ids[w] = codes[4 * at : 4 * (at + len(ids))]
            self._texts[w] = " ".join(strings[at : at + len(ids)])
            at += len(ids)

    def encode_texts(self, texts: list[str]) -> tuple[list[bytes], list[str]]:
        """Per text its ids as int32 bytes, and the decoded string: token strings joined by one space."""
        split: list[list[str]] = []
        special: dict[int, list] = {}
        for k, text in enumerate(texts):
            if self._special_pattern and self._special_pattern.search(text):
                pieces, at = [], 0
                for m in self._special_pattern.finditer(text):
                    pieces += [self.split(text[at : m.start()]), m.group()]
                    at = m.end()
                pieces.append(self.split(text[at:]))
                special[k] = pieces
                split.append([w for p in pieces if isinstance(p, list) for w in p])
            else:
                split.append(self.split(text))
        seen = set().union(*split)
        if not seen <= self._ids.keys():
            self._learn(seen)
            if not seen <= self._ids.keys():
                self._learn(seen)
        ids, strings = self._ids, self._texts
        codes = [b"".join(map(ids.__getitem__, words)) for words in split]
        decoded = [" ".join(filter(None, map(strings.__getitem__, words))) for words in split]
        for k, pieces in special.items():
            parts = [(b"".join(map(ids.__getitem__, p)), " ".join(filter(None, map(strings.__getitem__, p)))) if isinstance(p, list) else (np.int32(self.specials[p]).tobytes(), p) for p in pieces]
            codes[k] = b"".join(c for c, _ in parts)
            decoded[k] = " ".join(s for _, s in parts if s)
        return codes, decoded


_ascii_words = re.compile(WORDS.format(letter="[a-z]", number="[0-9]", space=r"\t-\r ", letters="a-z", numbers="0-9")).findall
_any_words = regex.compile(WORDS.format(letter=r"\p{L}", number=r"\p{N}", space=r"\p{White_Space}", letters=r"\p{L}", numbers=r"\p{N}")).findall
_encoders: dict[int, SpeculativeBPE] = {}


def _encoder(content: bytes) -> SpeculativeBPE:
    key = hash(content)
    if key not in _encoders:
        _encoders[key] = SpeculativeBPE(content)
    return _encoders[key]


def encode_column(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded string) of each row of df; `vocabulary` is a path that the driver can read, shipped once to each executor (about 2 MB)."""
    with open(vocabulary, "rb") as f:
        shipped = df.sparkSession.sparkContext.broadcast(f.read())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shipped.value)
        for batch in sliced(batches, text_col):
            codes, decoded = encoder.encode_texts([t or "" for t in batch.column(1).to_pylist()])
            offsets = np.concatenate([[0], np.cumsum([len(c) // 4 for c in codes])]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(codes), dtype=np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array(decoded, pa.string())], names=[id_col, "ids", "decoded"])

    return df.select(id_col, text_col).mapInArrow(encode, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, ids array<int>, decoded string")


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Token counts and digests of `encode_column`'s result."""
    return encoded.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
