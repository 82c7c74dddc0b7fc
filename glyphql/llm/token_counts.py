"""Exact byte-level BPE token counts at every prefix of a text, by prefix dynamic programming.

A sequence of tokens is the BPE encoding of its bytes exactly if each adjacent pair encodes to itself. So the last token
of the encoding of ``piece[:i]`` is the one token ``t`` that ends there and is compatible with the last token of
``piece[:i - len(t)]``, and ``count[i] = count[i - len(t)] + 1``. One pass over a piece gives the exact count of every
prefix; the cumulative sums over pieces give it for the text, and truncation and budget questions become look-ups.

Pieces are what the tokenizer's own splitting pattern yields. A text that stays within U+0000..U+024F is split by an
equivalent pattern with explicit classes of the standard library, other texts by ``regex`` with Unicode properties.

Defined results: null and empty texts have 0 bytes and 0 tokens; special strings inside a text count as one token each;
repeated rows are counted each for itself; an empty table gives an empty result; other columns are neither read nor
returned. Texts of any length are counted whole.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

LIMIT = 1024
#: The splitting pattern of the vocabulary, once by Unicode property and once for U+0000..U+024F.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_NUMBERS = "0-9²³¹¼-¾"
_BLANKS = "\\t\\n\\x0b\\x0c\\r \u0085 "
LATIN = re.compile(
    f"'(?:[stmd]|re|ve|ll)| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^{_BLANKS}{_LETTERS}{_NUMBERS}]+|[{_BLANKS}]+(?![^{_BLANKS}])|[{_BLANKS}]+"
)
ANY = regex.compile(PATTERN)
_BEYOND = re.compile("[^\u0000-ɏ]")
#: Entries of the memo of piece counts in one worker; beyond it the memo starts anew.
MEMO = 1_000_000
#: The key of a trie node's own token; the other keys are bytes.
TOKEN = 256


def split_pieces(text: str) -> list[str]:
    return (ANY if not text.isascii() and _BEYOND.search(text) else LATIN).findall(text)


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files: itself if printable in Latin-1, else 256 onwards in order."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    """Counts of all prefixes under one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        self.specials = [t["content"] for t in spec.get("added_tokens", []) if t.get("special")]
        self.ids = {raw(s): i for s, i in spec["model"]["vocab"].items() if s not in self.specials}
        self.bytes_of = {i: b for b, i in self.ids.items()}
        self.merged: dict[tuple[int, int], int] = {}
        #: How a token was made: its halves; bytes are their own halves. Later merges have higher ids.
        self.halves = {i: (i, i) for i in self.ids.values()}
        for m in spec["model"]["merges"]:
            a, b = m if isinstance(m, list) else m.split(" ")
            x, y = self.ids[raw(a)], self.ids[raw(b)]
            z = self.ids[raw(a) + raw(b)]
            self.merged.setdefault((x, y), z)
            if self.halves[z] == (z, z):
                self.halves[z] = (x, y)
        # Bytes take part before any merge, whatever their ids.
        self.rank = {i: (-1 if len(b) == 1 else i) for i, b in self.bytes_of.items()}
        self.reversed_trie: dict = {}
        for b, i in self.ids.items():
            node = self.reversed_trie
            for byte in reversed(b):
                node = node.setdefault(byte, {})
            node[TOKEN] = i
        self._step: dict[int, int] = {}  # by node << 8 | byte
        self._kept = [(-1, 0)]  # of each node: last token and count
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self._fits: dict[int, bool] = {}  # by left << 32 | right
        self.memo = _Memo(self)

    def _check(self, left: int, right: int) -> bool:
        """Whether the bytes of the two tokens, encoded together, give just these two tokens."""
        # Undo merges from the latest to the earliest. At each moment the parts that touch the seam must have no merge
        # that would have come before the one undone last.
        merged, halves, rank = self.merged, self.halves, self.rank
        bound, strict = None, False  # merges of a rank below bound (or equal, unless strict) would have come first
        while True:
            across = merged.get((left, right))
            if across is not None and (bound is None or across < bound or (across == bound and not strict)):
                return False
            rl, rr = rank[left], rank[right]
            if rl < 0 and rr < 0:
                return True
            if rl >= rr:
                # Of equal ranks the left one merges first: undo the right one first only if it is later.
                if rl == rr:
                    bound, strict, right = rr, False, halves[right][0]
                    continue
                bound, strict, left = rl, True, halves[left][1]
            else:
                bound, strict, right = rr, False, halves[right][0]

    def _last_token(self, piece: bytes, i: int, last: list[int]) -> tuple[int, int]:
        """The last token of the encoding of ``piece[:i]`` and its start; last: those of all shorter prefixes."""
        node, known, j = self.reversed_trie, self._fits, i
        while True:
            j -= 1
            node = node[piece[j]]
            t = node.get(TOKEN, -1)
            if t >= 0:
                if not j:
                    return t, j
                key = last[j] << 32 | t
                fit = known.get(key)
                if fit is None:
                    fit = known[key] = self._check(last[j], t)
                if fit:
                    return t, j

    def piece_prefixes(self, piece: bytes) -> list[int]:
        """``counts[i]``: tokens of ``piece[:i]``, for i from 0 to its length.

        Pieces begin alike, so what is known of a prefix is kept in a trie of prefixes that later pieces walk first."""
        step, kept = self._step, self._kept
        keep = len(piece) <= 48
        node, last, counts = 0, [-1], [0]
        for i in range(1, len(piece) + 1):
            key = node << 8 | piece[i - 1]
            node = step.get(key, -1) if keep else -1
            if node >= 0:
                t, n = kept[node]
            else:
                t, j = self._last_token(piece, i, last)
                n = counts[j] + 1
                if keep:
                    node = step[key] = len(kept)
                    kept.append((t, n))
            last.append(t)
            counts.append(n)
        if len(kept) > MEMO // 2:
            step.clear()
            kept[1:] = []
        if len(self._fits) > MEMO // 2:
            self._fits.clear()
        return counts

    def _segments(self, text: str) -> Iterator[tuple[str, bool]]:
        if self._special is None or not any(s in text for s in self.specials):
            yield text, False
            return
        for k, part in enumerate(self._special.split(text)):
            if part:
                yield part, bool(k % 2)

    def count(self, text: str) -> int:
        memo = self.memo
        total = 0
        for part, special in self._segments(text):
            total += 1 if special else sum(map(memo.__getitem__, split_pieces(part)))
        if len(memo) > MEMO:
            memo.clear()
        return total

    def prefix_counts(self, text: str) -> np.ndarray:
        """``counts[k]``: tokens of ``text[:k]`` encoded as a text of its own, for every k up to ``len(text)``."""
        out = np.zeros(len(text) + 1, np.int64)
        at = base = 0
        for part, special in self._segments(text):
            if special:
                # Until it is complete, a special string is ordinary text that continues what stands before it.
                start = max((m.end() for m in self._special.finditer(text, 0, at)), default=0)
                before = int(out[start])
                for k in range(at + 1, at + len(part)):
                    out[k] = before + sum(map(self.memo.__getitem__, split_pieces(text[start:k])))
                base += 1
                out[at + len(part)] = base
            else:
                out[at + 1 : at + len(part) + 1] = base + self._part_prefixes(part)[1:]
                base = int(out[at + len(part)])
            at += len(part)
        return out

    def _part_prefixes(self, text: str) -> np.ndarray:
        out = np.zeros(len(text) + 1, np.int64)
        at = total = 0
        blanks_from = None  # (position, tokens before it) where the running stretch of blanks began
        for piece in split_pieces(text):
            whole = self.piece_prefixes(piece.encode())
            if piece[0] == "'" and len(piece) > 2:  # a contraction; its part is no contraction yet
                for k in range(1, len(piece)):
                    out[at + k] = total + sum(map(self.memo.__getitem__, split_pieces(piece[:k])))
            else:
                end = 0
                for k, ch in enumerate(piece[:-1], 1):
                    end += len(ch.encode())
                    out[at + k] = total + whole[end]
            out[at + len(piece)] = total + whole[-1]
            # Blanks at the end of a prefix are one piece, however the whole text goes on.
            for k, ch in enumerate(piece):
                if _blank(ch):
                    blanks_from = blanks_from or (at + k, int(out[at + k]))
                    run = text[blanks_from[0] : at + k + 1]
                    out[at + k + 1] = blanks_from[1] + self.piece_prefixes(run.encode())[-1]
                else:
                    blanks_from = None
            total += whole[-1]
            at += len(piece)
            if not _blank(piece[-1]):
                out[at] = total
        if at and _blank(text[-1]):
            out[at] = total
        return out

    def cut(self, text: str, limit: int) -> int:
        """The length in characters of the longest prefix of at most ``limit`` tokens."""
        if len(text) <= limit:  # a character is at least a byte, a token at least a byte
            fit = self.count(text) <= limit
            if fit:
                return len(text)
        counts = self.prefix_counts(text)
        return int(np.flatnonzero(counts <= limit)[-1])


def _blank(ch: str) -> bool:
    return ch.isspace() and ch not in "\x1c\x1d\x1e\x1f"


class _Memo(dict):
    def __init__(self, counter: PrefixCounter):
        super().__init__()
        self._counter = counter

    def __missing__(self, piece: str) -> int:
        raw = piece.encode()
        n = self[piece] = 1 if raw in self._counter.ids and len(raw) > 1 else self._counter.piece_prefixes(raw)[-1]
        return n


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """One counter per worker process and file."""
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """id, ``n_bytes``, ``n_tokens``, ``over_limit`` of every row; Arrow batches in, no shuffle."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(path)
        for batch in batches:
            texts = batch.column(1)
            n_bytes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).cast(pa.int64())
            n = pa.array([counts.count(t) if t else 0 for t in texts.to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes, n, pa.compute.greater(n, limit)], ["id", "n_bytes", "n_tokens", "over_limit"])

    out = rows.mapInArrow(count, f"id {id_type}, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
