"""Benchmark decontamination by a generalised suffix automaton over the words of the test items.

The automaton holds every run of consecutive words of every item. Streaming a document's words through it tracks, at each
word, the longest run of item words that ends there. Where that length reaches the window, or a whole item shorter than
the window ends there, those words are hit.

Most words of a corpus cannot take part: a first pass hashes all words of a batch at once and keeps only the stretches
whose adjacent pairs of words all occur in some item, long enough for the shortest window. Only these are streamed, by
their real words, so hashes decide nothing.

The items travel to the executors only in chunks of bounded size (``ITEM_BYTES`` of text each); a larger benchmark takes
one pass per chunk, and the spans of all passes are united.

Defined results: null and empty texts have no words and no hits; a null or wordless item has no window; items with equal
texts each count; items with equal ids count once; a null item id takes part in hits but is not listed; repeated documents
are judged each for itself; an empty documents or benchmark table gives no rows or no hits; other columns are neither read
nor returned by :func:`hits`, and all pass through :func:`clean`.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import LOWER, UPPER, by_bytes, doc_chunks, release, table, utf8_view
from .wordhash import ALNUM, U64, mix, word_bounds, word_hashes

WINDOW = 10
ITEM_BYTES = 8 << 20
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOW = bytes.maketrans(UPPER.encode(), LOWER.encode())


def item_words(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode().translate(_LOW))


class Automaton:
    """Generalised suffix automaton of sequences of words."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        #: States of complete short items: (words, index of the item).
        short: dict[int, list[tuple[int, int]]] = {}
        #: Items that contain the strings of a state.
        self.items: list[set[int]] = [set()]
        self.ids = [i for i, _ in items]
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
        for k, (_, words) in enumerate(items):
            state = 0
            for w in words:
                state = self.next[state][w]
                at = state
                while at > 0 and k not in self.items[at]:
                    self.items[at].add(k)
                    at = self.link[at]
            if 0 < len(words) < window:
                short.setdefault(state, []).append((len(words), k))
        #: Short items that are a suffix of a state's strings, if those are long enough.
        self.short: list[list[tuple[int, int]]] = [[] for _ in self.next]
        for state in sorted(range(len(self.next)), key=lambda s: self.length[s]):
            above = self.short[self.link[state]] if state else []
            self.short[state] = above + short.get(state, [])
        self.least = min([window, *(n for v in short.values() for n, _ in v)]) if items else window

    def _new(self, length: int, nexts: dict, link: int) -> int:
        self.next.append(nexts)
        self.length.append(length)
        self.link.append(link)
        self.items.append(set())
        return len(self.next) - 1

    def _extend(self, last: int, w: bytes) -> int:
        if w in self.next[last]:
            q = self.next[last][w]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        new = self._new(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return new

    def _split(self, p: int, w: bytes, q: int) -> int:
        copy = self._new(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def stream(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit spans of words (end exclusive, united, in order) and the items whose windows occur."""
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        state = matched = 0
        for k, w in enumerate(words):
            while state and w not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if w not in self.next[state]:
                continue
            state, matched = self.next[state][w], matched + 1
            reach = 0
            if matched >= self.window:
                reach = self.window
                at = state
                while self.length[self.link[at]] >= self.window:
                    at = self.link[at]
                found |= self.items[at]
            for n, item in self.short[state]:
                if n <= matched:
                    reach = max(reach, n)
                    found.add(item)
            if reach:
                start = k + 1 - reach
                while spans and spans[-1][1] > start:
                    start = min(start, spans.pop()[0])
                spans.append((start, k + 1))
        return spans, found


def pair_keys(hashes: np.ndarray) -> np.ndarray:
    return mix(hashes[:-1] * U64(0x9E3779B97F4A7C15) + hashes[1:])


class Matcher:
    """The automaton behind the filter by hashed pairs of words."""

    def __init__(self, items: list[tuple[object, str]], window: int):
        sequences = [(i, item_words(t)) for i, t in items]
        self.automaton = Automaton(sequences, window)
        vocabulary = sorted({w for _, ws in sequences for w in ws})
        raw = np.frombuffer(b"".join(vocabulary), np.uint8)
        ends = np.cumsum([len(w) for w in vocabulary]).astype(np.int64)
        starts = ends - np.array([len(w) for w in vocabulary], np.int64) if vocabulary else ends
        of = dict(zip(vocabulary, word_hashes(raw, starts, ends).tolist(), strict=True))
        self.single = np.unique(np.array([of[ws[0]] for _, ws in sequences if len(ws) == 1], np.uint64))
        pairs = [pair_keys(np.array([of[w] for w in ws], np.uint64)) for _, ws in sequences if len(ws) > 1]
        self.pairs = np.unique(np.concatenate([*pairs, np.zeros(0, np.uint64)]))
        self.flags = np.zeros(1 << 20, bool)  # a quick first look-up of pairs, by 20 bits
        self.flags[(self.pairs >> U64(44)).astype(np.int64)] = True

    def match(self, column: pa.Array) -> Iterator[tuple[int, list[tuple[int, int]], set[int], list[tuple[int, int]]]]:
        """Of each text: number of words, hit spans of words, found items, and the spans as byte ranges."""
        buf, offsets = utf8_view(column)
        for i, j in doc_chunks(offsets):
            part, offs = buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            starts, ends = word_bounds(part, offs, ALNUM)
            hashes = word_hashes(part, starts, ends)
            at = np.searchsorted(starts, offs)
            hit = np.zeros(max(len(hashes) - 1, 0), bool)
            if len(hashes) > 1 and len(self.pairs):
                keys = pair_keys(hashes)
                maybe = np.flatnonzero(self.flags[(keys >> U64(44)).astype(np.int64)])
                hit[maybe[np.isin(keys[maybe], self.pairs)]] = True
                inner = at[1:-1]
                inner = inner[(inner > 0) & (inner < len(hashes))]
                hit[inner - 1] = False  # a pair across two documents
            alone = np.flatnonzero(np.isin(hashes, self.single)) if len(self.single) else np.zeros(0, np.int64)
            edge = np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))
            runs = list(zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 1, strict=True))
            runs = [(a, b) for a, b in runs if b - a >= self.automaton.least]
            if len(alone):
                covered = np.zeros(len(hashes), bool)
                for a, b in runs:
                    covered[a:b] = True
                runs = sorted(runs + [(k, k + 1) for k in alone[~covered[alone]]])
            of_doc: dict[int, list[tuple[int, int]]] = {}
            for a, b in runs:
                of_doc.setdefault(int(np.searchsorted(at, a, side="right")) - 1, []).append((int(a), int(b)))
            for d in range(j - i):
                spans: list[tuple[int, int]] = []
                found: set[int] = set()
                places: list[tuple[int, int]] = []
                for a, b in of_doc.get(d, ()):
                    words = [bytes(part[starts[k] : ends[k]]).translate(_LOW) for k in range(a, b)]
                    got, items = self.automaton.stream(words)
                    found |= items
                    for s, e in got:
                        spans.append((a + s - int(at[d]), a + e - int(at[d])))
                        places.append((int(starts[a + s] - offs[d]), int(ends[a + e - 1] - offs[d])))
                yield int(at[d + 1] - at[d]), spans, found, places


_MATCHERS: dict[str, Matcher] = {}


def _matcher(key: str, items: list, window: int) -> Matcher:
    if key not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[key] = Matcher(items, window)
    return _MATCHERS[key]


def _item_chunks(benchmark: DataFrame, item_id: str, item_text: str) -> Iterator[list[tuple[str | None, str]]]:
    """The items in chunks of bounded size, streamed partition by partition."""
    chunk: list[tuple[str | None, str]] = []
    size = 0
    rows = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t")).where("t is not null")
    for r in rows.toLocalIterator():
        if chunk and size + len(r["t"]) > ITEM_BYTES:
            yield chunk
            chunk, size = [], 0
        chunk.append((r["i"], r["t"]))
        size += len(r["t"])
    yield chunk


def unite(spans: list[list[int]]) -> list[list[int]]:
    """Sorted spans without overlap; spans that only touch stay apart."""
    out: list[list[int]] = []
    for s, e in sorted((int(s), int(e)) for s, e in spans):
        if out and s < out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def annotate(rows: DataFrame, benchmark: DataFrame, finish: Callable, schema: str | StructType, text_col: str, item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """One pass over ``rows`` for each chunk of items, without a shuffle; the last one returns what ``finish`` makes.

    finish: gets a slice of a batch of ``rows`` and of each row a dict with ``n``, ``spans`` (of words), ``places`` (of bytes) and
    ``items``, and returns a batch of ``schema``."""
    sc = rows.sparkSession.sparkContext
    state = "_decontaminate_state"
    columns, out = len(rows.columns), rows
    text_at = rows.columns.index(text_col)
    between = StructType([*rows.schema.fields, StructField(state, StringType())])
    chunks = _item_chunks(benchmark, item_id, item_text)
    chunk: list | None = next(chunks)
    while chunk is not None:
        after = next(chunks, None)
        sent = sc.broadcast(chunk)
        key = hashlib.sha256(repr((window, chunk)).encode()).hexdigest()

        def run(batches: Iterator[pa.RecordBatch], sent=sent, key=key, last=after is None) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(key, sent.value, window)
            ids = matcher.automaton.ids
            for batch in by_bytes(batches, text_at):
                own = batch.select(range(columns))
                before = batch.column(columns).to_pylist() if batch.num_columns > columns else [None] * len(batch)
                got = []
                for (n, spans, items, places), old in zip(matcher.match(batch.column(text_at)), before, strict=True):
                    old = json.loads(old) if old else {"spans": [], "places": [], "items": []}
                    got.append({"n": n} | {k: unite([*old[k], *v]) for k, v in (("spans", spans), ("places", places))})
                    got[-1]["items"] = sorted({*old["items"], *(ids[k] for k in items if ids[k] is not None)})
                if last:
                    yield finish(own, got)
                else:
                    states = [json.dumps(g) if g["spans"] else None for g in got]
                    yield pa.RecordBatch.from_arrays([*own.columns, pa.array(states, pa.string())], [*own.schema.names, state])
            release()

        out = out.mapInArrow(run, schema if after is None else between)
        chunk = after
    return out


def hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """id, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``, ``contaminated`` of every row."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    names = ["id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]

    def finish(batch: pa.RecordBatch, got: list[dict]) -> pa.RecordBatch:
        hit = [sum(e - s for s, e in g["spans"]) for g in got]
        digests = [hashlib.sha256(",".join(g["items"]).encode()).hexdigest() for g in got]
        numbers = [pa.array(x, pa.int64()) for x in ([g["n"] for g in got], hit, [len(g["items"]) for g in got])]
        return pa.RecordBatch.from_arrays([batch.column(0), *numbers, pa.array(digests, pa.string()), pa.array([h > 0 for h in hit], pa.bool_())], names)

    schema = f"id {rows.schema['id'].dataType.simpleString()}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    return annotate(rows, benchmark, finish, schema, "text", **options).withColumnRenamed("id", id_col)


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", most_words: int = 0, most_share: float = 0.0, **options) -> DataFrame:
    """``docs`` with all rows and columns, the hit spans cut from a text in which the longest one has more than
    ``most_words`` words or all of them more than ``most_share`` of its words. Other bytes remain as they are."""
    at = docs.columns.index(text_col)

    def finish(batch: pa.RecordBatch, got: list[dict]) -> pa.RecordBatch:
        texts = batch.column(at).to_pylist()
        for k, g in enumerate(got):
            hit = [e - s for s, e in g["spans"]]
            if hit and (max(hit) > most_words or sum(hit) > most_share * g["n"]):
                raw, kept, to = texts[k].encode(), [], 0
                for s, e in g["places"]:
                    kept.append(raw[to:s])
                    to = e
                texts[k] = b"".join([*kept, raw[to:]]).decode()
        columns = list(batch.columns)
        columns[at] = pa.array(texts, batch.schema.field(at).type)
        return pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return annotate(docs, benchmark, finish, docs.schema, text_col, **options)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, len(w[k : k + least(len(w), 10) - 1]) AS m, array_to_string(w[k : k + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS k FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT m FROM win),
pos AS (SELECT doc_id, w, m, unnest(generate_series(1, len(w) - m + 1)) AS k FROM d, sizes WHERE len(w) >= m),
occ AS (
  SELECT p.doc_id, p.k, p.m, win.item_id FROM (SELECT doc_id, k, m, array_to_string(w[k : k + m - 1], ' ') AS g FROM pos) p JOIN win ON win.g = p.g AND win.m = p.m
), hit AS (
  SELECT doc_id, count(DISTINCT k + o) AS n_hit FROM (SELECT DISTINCT doc_id, k, m, unnest(generate_series(0, m - 1)) AS o FROM occ) GROUP BY doc_id
), its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM occ) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
