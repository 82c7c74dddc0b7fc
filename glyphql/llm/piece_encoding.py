"""SentencePiece encoding that keeps offsets, and decoding, for BPE models with byte fallback.

Normalisation looks up the longest prefix in the model's compiled character map (a double-array trie with a pool of
replacements), or copies one character, and records for every character of its output the source byte range it stands for.
Characters with which no key begins are copied run by run. Encoding merges the best-scored adjacent symbols within stretches
that no piece can straddle, and each piece is projected through the alignment to a byte span of the original text. Stretches
recur, so their ids, decoded surface and pieces' lengths are kept in a memo of bounded size; spans are each text's own. The
stretches of a slice of texts that the memo lacks are merged together, all short ones a merge each per step (:class:`_Merges`).

Defined results: null and empty texts have no pieces, only the end id if one is asked for, and decode to an empty text;
repeated rows are encoded each for itself; an empty table gives an empty result; other columns are neither read nor
returned. Texts of any length are encoded whole.
"""

from __future__ import annotations

import bisect
import hashlib
import heapq
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, release, table

MARK = "▁"
#: Piece types of the model format.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Stretches in the memo of one worker; beyond it the memo starts anew.
MEMO = 75_000
#: Stretches of up to this many characters merge together with others, longer ones each with a heap.
SHORT = 48
#: Cells (characters and two borders for each stretch) that merge together; bounds the arrays' size.
CELLS = 1 << 16


class CharMap:
    """Longest-prefix replacement by a compiled character map: ``uint32 trie size | double-array trie | NUL-ended pool``."""

    def __init__(self, blob: bytes):
        self.units: tuple[int, ...] = ()
        self.pool = b""
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
            self.pool = blob[4 + size :]
        first = self._first()
        #: Runs of characters with which no key begins; by whether blanks count as such a beginning.
        self.plain = {squeeze: re.compile(f"[^{c}]+" if (c := first + " " * squeeze) else "(?s:.+)") for squeeze in (False, True)}

    def _first(self) -> str:
        """The characters whose first byte begins a key, as ranges of a regular expression's class."""
        if not self.units:
            return ""
        root = (self.units[0] >> 10) << ((self.units[0] & (1 << 9)) >> 6)
        out = []
        for b in range(1, 0xF5):
            if (at := root ^ b) < len(self.units) and self.units[at] & ((1 << 31) | 0xFF) == b:
                bits = 0 if b < 0x80 else 6 if b < 0xE0 else 12 if b < 0xF0 else 18
                low = (b & (0x7F if b < 0x80 else 0x1F if b < 0xE0 else 0x0F if b < 0xF0 else 0x07)) << bits
                out.append(f"\\U{low:08x}-\\U{min(low + (1 << bits) - 1, 0x10FFFF):08x}")
        return "".join(out)

    def longest(self, raw: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest key that starts at ``raw[at]``."""
        if not self.units:
            return None
        units, found, pos = self.units, None, 0
        unit = units[0]
        pos ^= (unit >> 10) << ((unit & (1 << 9)) >> 6)
        for k in range(at, len(raw)):
            pos ^= raw[k]
            if pos >= len(units):
                break
            unit = units[pos]
            if unit & ((1 << 31) | 0xFF) != raw[k]:
                break
            pos ^= (unit >> 10) << ((unit & (1 << 9)) >> 6)
            if (unit >> 8) & 1:
                found = (k + 1 - at, units[pos] & ((1 << 31) - 1))
        if found is None:
            return None
        length, start = found
        return length, self.pool[start : self.pool.index(b"\0", start)]


@dataclass(frozen=True)
class Normalised:
    text: str
    #: For each character of ``text``, and once more for its end: the byte offset in the source.
    source: list[int]


class PieceModel:
    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        spec = pb.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        n = spec.normalizer_spec
        if spec.trainer_spec.model_type != spec.trainer_spec.BPE or not n.escape_whitespaces or spec.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only BPE models that mark blanks before words are supported")
        if any(p.type in (USER, UNUSED) for p in spec.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.chars = CharMap(n.precompiled_charsmap)
        self.dummy_prefix, self.squeeze = n.add_dummy_prefix, n.remove_extra_whitespaces
        self.ids = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == NORMAL}
        self.score = {p.piece: p.score for p in spec.pieces if p.type == NORMAL}
        self.pieces = [p.piece for p in spec.pieces]
        self.types = [p.type for p in spec.pieces]
        self.byte_ids = {int(p.piece[1:-1], 16): i for i, p in enumerate(spec.pieces) if p.type == BYTE}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        self.unk = self.types.index(UNKNOWN)
        self.unk_surface = spec.trainer_spec.unk_surface
        self.end = spec.trainer_spec.eos_id
        if not self.byte_ids:
            raise ValueError("only models with byte fallback are supported")
        # A stretch ends where no piece can straddle: before a mark, around a line feed, between letters and others.
        latin = "A-Za-zÀ-ÖØ-öø-ɏ"
        letters = re.compile(f"[{latin}]")
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            self.stretches = re.compile(r"(?s).+")
        elif any("\n" in p for p in self.ids) or any(len({bool(letters.match(c)) for c in p.lstrip(MARK)}) > 1 for p in self.ids):
            self.stretches = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        else:
            self.stretches = re.compile(rf"\n|{MARK}*[{latin}]+|{MARK}*[^{latin}{MARK}\n]+|{MARK}+")
        self.merges = _Merges(self)
        self.memo = _Memo(self)

    # Normalisation

    def normalise(self, text: str) -> Normalised:
        """The text as the encoder sees it, aligned to the bytes of ``text``."""
        body, source = self._aligned(text)
        return Normalised(body, source.tolist())

    def _aligned(self, text: str) -> tuple[str, np.ndarray]:
        raw = text.encode()
        if len(raw) == len(text):
            offsets = np.arange(len(raw) + 1)
        else:
            offsets = np.append(np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80), len(raw))
        out: list[str] = []
        source: list[np.ndarray] = []

        def put(s: str, at: np.ndarray) -> None:
            out.append(s.replace(" ", MARK))
            source.append(at)

        at, plain = 0, self.chars.plain[self.squeeze]
        if self.squeeze:
            while at < len(text) and (step := self._one(raw, int(offsets[at])))[1] == " ":
                at += len(raw[offsets[at] : offsets[at] + step[0]].decode())
        if at < len(text) and self.dummy_prefix:
            put(MARK, offsets[at : at + 1])
        blank = self.squeeze
        while at < len(text):
            if run := plain.match(text, at):
                put(run.group(), offsets[at : run.end()])
                at, blank = run.end(), False
                continue
            start = int(offsets[at])
            length, s = self._one(raw, start)
            while blank and s.startswith(" "):
                s = s[1:]
            if s:
                put(s, np.full(len(s), start))
                blank = self.squeeze and s.endswith(" ")
            at += len(raw[start : start + length].decode())
        body, aligned = "".join(out), np.concatenate([*source, offsets[-1:]])
        if self.squeeze and body.endswith(MARK):
            body = body.rstrip(MARK)
            aligned = aligned[: len(body) + 1]
        return body, aligned

    def _one(self, raw: bytes, at: int) -> tuple[int, str]:
        """Bytes taken and their replacement at one step."""
        found = self.chars.longest(raw, at)
        if found is not None:
            return found[0], found[1].decode()
        b = raw[at]
        length = 1 if b < 0x80 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4
        return length, raw[at : at + length].decode()

    # Encoding

    def merge(self, stretch: str) -> list[str]:
        """The symbols of one stretch: the adjacent pair of the best score merges first, of equals the leftmost."""
        score = self.score
        symbols = list(stretch)
        if len(symbols) <= 24:
            while len(symbols) > 1:
                best, at = None, -1
                for i in range(len(symbols) - 1):
                    s = score.get(symbols[i] + symbols[i + 1])
                    if s is not None and (best is None or s > best):
                        best, at = s, i
                if at < 0:
                    break
                symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            return symbols
        after = [*range(1, len(symbols)), -1]
        before = [-1, *range(len(symbols) - 1)]
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (s := score.get(symbols[i] + symbols[j])) is not None:
                heapq.heappush(heap, (-s, i, j, symbols[i] + symbols[j]))

        for i in range(len(symbols) - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if not symbols[i] or not symbols[j] or symbols[i] + symbols[j] != both or after[i] != j:
                continue
            symbols[i], symbols[j] = both, ""
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [s for s in symbols if s]

    def symbol_ids(self, symbol: str) -> list[int]:
        known = self.ids.get(symbol)
        return [known] if known is not None else [self.byte_ids[b] for b in symbol.encode()]

    def encode(self, text: str) -> list[tuple[int, int, int]]:
        """(id, start, end) of every piece: a byte span of ``text``; the bytes of one unknown character share its span."""
        joined, _, _, spans = self.encode_fast(text)
        return [(int(i), *span) for i, span in zip(joined.split(), spans.tolist(), strict=True)]

    def encode_fast(self, text: str) -> tuple[str, int, str, np.ndarray]:
        """Ids as decimals joined by blanks, their number, the decoded text, and a row ``start, end`` for each id: the byte
        span of ``text`` that its piece stands for."""
        return next(self.encode_all([text]))

    def encode_all(self, texts: list[str]) -> Iterator[tuple[str, int, str, np.ndarray]]:
        """:meth:`encode_fast` of each text; what the memo lacks for them is merged together."""
        aligned = [self._aligned(text) for text in texts]
        cut = [self.stretches.findall(body) for body, _ in aligned]
        if len(self.memo) > MEMO:
            self.memo.clear()
        self.memo.learn(set().union(*cut))
        for (body, source), own in zip(aligned, cut, strict=True):
            found = list(map(self.memo.__getitem__, own))
            ids, surfaces, lengths = zip(*found) if found else ((), (), ())
            # Characters of each piece; of the byte pieces of one character the last has its 1, the others 0.
            taken = np.frombuffer(b"".join(lengths), np.uint32).astype(np.int64)
            start = np.cumsum(taken) - taken
            spans = np.stack([source[start], source[start + np.maximum(taken, 1)]], axis=1)
            surface = "".join(surfaces)
            if (self.dummy_prefix or self.squeeze) and body.startswith(MARK) and surface.startswith(" "):
                surface = surface[1:]
            yield " ".join(ids), len(taken), surface, spans

    # Decoding

    def surface(self, ids: list[int]) -> str:
        """The text of ids in the middle of a text; runs of byte pieces decode together, invalid bytes to U+FFFD each."""
        out: list[str] = []
        run = bytearray()
        for i in [*ids, -1]:
            if i >= 0 and self.types[i] == BYTE:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(_lenient(bytes(run)))
                run.clear()
            if i >= 0 and self.types[i] == NORMAL:
                out.append(self.pieces[i].replace(MARK, " "))
            elif i == self.unk:
                out.append(self.unk_surface)
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        text = self.surface(ids)
        first = next((i for i in ids if self.types[i] != CONTROL), -1)
        marked = first >= 0 and self.types[first] == NORMAL and self.pieces[first].startswith(MARK)
        return text[1:] if marked and (self.dummy_prefix or self.squeeze) else text


def _lenient(raw: bytes) -> str:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    out.append(raw[at : at + n].decode())
                    at += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


class _Merges:
    """:meth:`PieceModel.merge` of many short stretches at once.

    Symbols are numbers: 0 for borders and characters that no piece has, the others for pieces and their characters. Every way
    to put a piece together from two symbols is a pair, with its piece's place in the order of scores. Each step merges the
    best pair of every stretch that has one, of equals the leftmost, and looks up the two pairs that this makes."""

    def __init__(self, model: PieceModel):
        numbers = {s: k for k, s in enumerate(dict.fromkeys([*model.ids, *(c for p in model.ids for c in p)]), 1)}
        self.width = len(numbers) + 1
        of_score = {x: k for k, x in enumerate(sorted(set(model.score.values()), reverse=True))}
        self.none = len(of_score)
        pairs = sorted(
            (numbers[p[:k]] * self.width + numbers[p[k:]], of_score[model.score[p]], numbers[p])
            for p in model.ids
            for k in range(1, len(p))
            if p[:k] in numbers and p[k:] in numbers
        )
        # The last entry is no pair's.
        self.keys, self.ranks, self.merged = (np.array(x, t) for x, t in zip(zip(*pairs, (1 << 62, self.none, 0)), (np.int64, np.int32, np.int32), strict=True))
        single = {ord(s): k for s, k in numbers.items() if len(s) == 1}
        self.of_char = np.zeros(max(single, default=0) + 2, np.int32)
        self.of_char[list(single)] = list(single.values())
        self.ids = np.array([-1, *(model.ids.get(s, -1) for s in numbers)], np.int32)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Places of the pairs in the table; the last one's for symbols that make no piece."""
        wanted = left.astype(np.int64) * self.width + right
        at = np.searchsorted(self.keys, wanted)
        at[self.keys[at] != wanted] = len(self.keys) - 1
        return at

    def __call__(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For the symbols of all stretches in turn their ids (-1: not a piece) and lengths, and their number by stretch."""
        sizes = np.fromiter(map(len, stretches), np.int64, len(stretches))
        n, wide = len(stretches), int(sizes.max()) + 2
        chars = np.frombuffer("".join(stretches).encode("utf-32-le"), np.uint32)
        inside = np.arange(wide) < sizes[:, None] + 1
        inside[:, 0] = False
        live = inside.ravel()
        symbol = np.zeros(n * wide, np.int32)
        symbol[live] = self.of_char[np.minimum(chars, len(self.of_char) - 1)]
        after = np.arange(1, n * wide + 1)
        before = np.arange(-1, n * wide - 1)
        pair = np.full(n * wide, len(self.keys) - 1)
        heads = np.flatnonzero(live)
        pair[heads] = self._pairs(symbol[heads], symbol[heads + 1])
        rank = self.ranks[pair].reshape(n, wide)
        flat = rank.ravel()
        rows = np.arange(n)
        while len(rows):
            at = rows * wide + rank[rows].argmin(axis=1)
            some = flat[at] < self.none
            rows, at = rows[some], at[some]
            gone, left = after[at], before[at]
            right = after[gone]
            symbol[at] = new = self.merged[pair[at]]
            live[gone], flat[gone] = False, self.none
            after[at], before[right] = right, at
            pair[at] = own = self._pairs(new, symbol[right])
            flat[at] = self.ranks[own]
            pair[left] = own = self._pairs(symbol[left], new)
            flat[left] = self.ranks[own]
        heads = np.flatnonzero(live)
        return self.ids[symbol[heads]], (after[heads] - heads).astype(np.uint32), live.reshape(n, wide).sum(axis=1)


class _Memo(dict):
    """Of each stretch: its ids as decimals joined by blanks, their decoded text, and the characters of each id's piece."""

    def __init__(self, model: PieceModel):
        super().__init__()
        self._model = model
        self._decimals = [str(i) for i in range(len(model.pieces))]
        self._surfaces = [model.surface([i]) for i in range(len(model.pieces))]

    def learn(self, stretches: set[str]) -> None:
        """Adds those of the stretches that are not there yet."""
        m = self._model
        new = sorted(stretches.difference(self), key=len)
        at, short = 0, bisect.bisect_right(new, SHORT, key=len)
        while at < short:
            end = min(short, at + CELLS // (len(new[at]) + 2))
            end = min(end, at + CELLS // (len(new[end - 1]) + 2))
            self._add(new[at:end])
            at = end
        for stretch in new[short:]:
            self[stretch] = self._entry(m.merge(stretch))

    def _add(self, stretches: list[str]) -> None:
        ids, lengths, counts = self._model.merges(stretches)
        ends = np.cumsum(counts)
        known = np.bincount(np.repeat(np.arange(len(stretches)), counts), ids < 0, len(stretches)) == 0
        own = ids.tolist()
        decimals, surfaces = [self._decimals[i] for i in own], [self._surfaces[i] for i in own]
        taken = lengths.tobytes()
        for stretch, a, b, pieces in zip(stretches, (ends - counts).tolist(), ends.tolist(), known.tolist(), strict=True):
            if pieces:
                self[stretch] = " ".join(decimals[a:b]), "".join(surfaces[a:b]), taken[4 * a : 4 * b]
            else:
                cuts = np.cumsum(lengths[a:b]).tolist()
                self[stretch] = self._entry([stretch[i:j] for i, j in zip([0, *cuts], cuts)])

    def _entry(self, symbols: list[str]) -> tuple[str, str, bytes]:
        m = self._model
        ids: list[int] = []
        taken: list[int] = []
        for symbol in symbols:
            own = m.symbol_ids(symbol)
            ids += own
            taken += [0] * (len(own) - 1) + [len(symbol)]
        return " ".join(map(str, ids)), m.surface(ids), np.array(taken, np.uint32).tobytes()


_MODELS: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    """One model per worker process and file."""
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``ids`` (without the end id), ``starts`` and ``ends`` of each piece's byte span, and the ``decoded`` text; no shuffle."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            for k in range(0, len(batch), 64):
                part = batch.slice(k, 64)
                ids, starts, ends, decoded = [], [], [], []
                for joined, _, back, spans in m.encode_all([text or "" for text in part.column(1).to_pylist()]):
                    ids.append(np.array(joined.split(), np.int32))
                    starts.append(spans[:, 0])
                    ends.append(spans[:, 1])
                    decoded.append(back)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64())), pa.array(decoded, pa.string())], ["id", "ids", "starts", "ends", "decoded"])
        m.memo.clear()
        release()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(encode, f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>, starts array<long>, ends array<long>, decoded string").withColumnRenamed("id", id_col)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of :func:`encode_texts`, where the texts are: id, ``n_tokens`` and ``ids_sha256`` (with the end id),
    ``decoded_sha256``, ``n_span_bytes``, ``spans_sha256``; no shuffle.

    ``n_span_bytes``: bytes of the text that the pieces' spans cover. ``spans_sha256``: of each piece's start and end in turn,
    as unsigned 32-bit little-endian numbers."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_span_bytes long, spans_sha256 string"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        end = str(m.end)
        for batch in by_bytes(batches, 1):
            n, ids, decoded, covered, placed = [], [], [], [], []
            for joined, count, back, spans in m.encode_all([text or "" for text in batch.column(1).to_pylist()]):
                n.append(count + 1)
                ids.append(hashlib.sha256(f"{joined} {end}".encode() if joined else end.encode()).hexdigest())
                decoded.append(hashlib.sha256(back.encode()).hexdigest())
                # Spans ascend; the byte pieces of one character repeat its span.
                covered.append(int((spans[:, 1] - np.maximum(spans[:, 0], np.append(0, spans[:-1, 1]))).sum()) if count else 0)
                placed.append(hashlib.sha256(spans.astype("<u4").tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string()), pa.array(covered, pa.int64()), pa.array(placed, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256", "n_span_bytes", "spans_sha256"])
        m.memo.clear()
        release()

    return rows.mapInArrow(encode, schema).withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
