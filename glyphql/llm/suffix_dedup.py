"""Removal of repeated substrings by a distributed, common-prefix-aware merge sort of suffixes.

Every byte that lies in a string of ``length`` bytes which also starts in a document with a smaller id is removed.

Which suffixes are sorted. A window of ``length`` bytes has an anchor: the position of its least hash among its grams of
``GRAM`` bytes, the leftmost of equals. Equal windows have their anchors at equal places, so it is enough to sort the
suffixes that begin at anchors, each with the ``length - GRAM`` bytes to its left: about one byte in fourteen.

1. Anchor hashes meet in buckets, as sorted runs of 32-bit remainders; those of a single document go no further, and those
   of more than ``HOT`` documents are marked.
2. Each task sorts the suffixes at its remaining anchors. Of equal surroundings within a task only those of the smallest
   document travel; the others' bytes are covered already. Runs travel front-coded: the length of the prefix shared with
   the suffix before, and the rest. At a marked anchor, whose suffixes would all meet in one bucket, the windows themselves
   are sorted instead, each in the bucket of its own hash: of equal ones a task sends one, unequal ones part.
3. A bucket's runs, decoded one string ahead, merge in a loser tree that keeps, for each contender, the length of the prefix
   it shares with the last winner. Contenders are compared only where these lengths are equal, and only beyond them.
4. The merged order and its shared lengths give, for every number of bytes right of the anchor, the classes of equal right
   sides; the same for the left sides; windows are equal if both are. The smallest document of a class keeps its bytes.
5. The covered ranges return to the rows and are cut.

The texts are copied once to the shared folder, so that all passes see the same files and rows. Later passes pick up what
concerns a file from tables written by file, so texts are never shuffled.

Defined results: a null text is empty; strings are judged on the input, at any length of text and with any bytes; a row
never covers itself or another row of its id; a null id counts as larger than all others; rows repeated with different ids
lose all bytes but for the smallest id, if they have ``length`` bytes; texts shorter than that stay whole; an empty table
gives an empty result; other columns pass through :func:`clean` whatever their names, but for that of the spans, which must
be free. Ids are integers.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from .common import discard, doc_chunks, fresh_path, materialise, release, shuffle_partitions, table, utf8_view
from .wordhash import BYTE_KEYS, U64, mix

LENGTH = 50
GRAM = 24
#: Longer texts are searched in parts that overlap by a window less one byte.
PART_BYTES = 1 << 20
#: Shorter ones are searched together, up to so many bytes.
CHUNK_BYTES = 1 << 19
#: Anchors that a task holds before it sends them, and suffixes.
HELD, HELD_SUFFIXES = 600_000, 150_000
#: Buckets for each shuffle partition: what a task merges at once is that much less.
BUCKETS = 16
#: An anchor that more documents have is split by its windows. Each run of anchors counts at most 255 for one anchor.
HOT = 4096
NO_ID = np.iinfo(np.int64).max

_KEYS = BYTE_KEYS.copy()
_KEYS[65:91] = mix(np.arange(1, 27, dtype=np.uint64) * U64(0x9E3779B97F4A7C15)) | U64(1)  # here, case matters
_BASE = 0x9E3779B97F4A7C15


def gram_hashes(buf: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n bytes, joined from runs of powers of two."""
    powers = {1: _KEYS[buf]}
    size = 1
    while size * 2 <= n:
        h = powers[size]
        powers[size * 2] = h[:-size] * U64(pow(_BASE, size, 1 << 64)) + h[size:]
        size *= 2
    out, have = powers[size], size
    while have < n:
        size = 1 << ((n - have).bit_length() - 1)
        out = out[: len(buf) - have - size + 1] * U64(pow(_BASE, size, 1 << 64)) + powers[size][have : len(buf) - size + 1]
        have += size
    return mix(out)


def anchors(buf: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions in ``buf`` of the anchors of all windows that lie within one document, their hashes, and the start of the
    first and the number of the windows, one after the other, that each is the anchor of."""
    n, none = len(buf), np.zeros(0, np.int64)
    if n < length:
        return none, none.astype(np.uint64), none, none
    hashes = gram_hashes(buf, gram)
    keys = (hashes >> U64(24) << U64(24)) | np.arange(len(hashes), dtype=np.uint64)
    width, size, least = length - gram + 1, 1, keys
    while size * 2 <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < width:
        least = np.minimum(least[: len(keys) - width + 1], least[width - size :])
    # Windows that reach over the end of a document do not count.
    ends = offsets[1:]
    starts = np.arange(len(least))
    whole = starts + length <= np.repeat(ends, np.diff(offsets))[: len(least)]
    found = (least[whole] & U64(0xFFFFFF)).astype(np.int64)
    if not len(found):
        return none, none.astype(np.uint64), none, none
    first = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
    found, windows = found[first], np.diff(np.append(first, len(found)))
    return found, hashes[found], starts[whole][first], windows


def _parts(offsets: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pieces of a batch: byte offsets, the row of each document in it, and where in its text the document begins."""
    for i, j in doc_chunks(offsets, CHUNK_BYTES):
        if offsets[j] - offsets[i] <= PART_BYTES:
            yield offsets[i : j + 1], np.arange(i, j), np.zeros(j - i, np.int64)
            continue
        start, end = int(offsets[i]), int(offsets[j])  # one long document
        for at in range(start, max(start + 1, end - length + 1), PART_BYTES):
            yield np.array([at, min(end, at + PART_BYTES + length - 1)]), np.array([i]), np.array([at - start])


def _anchored(texts: pa.Array, length: int, gram: int) -> Iterator[tuple]:
    """For each piece of a batch: bytes, row and place (in the whole text) of each anchor, position in the bytes, hash,
    the first and last byte of the document, and the anchor's windows."""
    buf, offsets = utf8_view(texts)
    for offs, rows, bases in _parts(offsets, length):
        part = buf[offs[0] : offs[-1]]
        local = offs - offs[0]
        at, hashes, first, windows = anchors(part, local, length, gram)
        doc = np.searchsorted(local, at, side="right") - 1
        yield part, rows[doc], at - local[doc] + bases[doc], at, hashes, local[doc], local[doc + 1], first, windows


def _by_file(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Stretches of rows of the same file."""
    files = batch.column(0).to_numpy()
    cuts = np.concatenate([[0], np.flatnonzero(files[1:] != files[:-1]) + 1, [len(files)]])
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            yield int(files[a]), batch.slice(a, b - a)


def _written(path: str, file: int) -> pa.Table | None:
    """What a table partitioned by file has of one file."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    files, at = fs.FileSystem.from_uri(path)
    info = files.get_file_info(fs.FileSelector(f"{at}/file={file}", allow_not_found=True))
    tables = [pq.read_table(files.open_input_file(x.path)) for x in info if x.path.endswith(".parquet")]
    return pa.concat_tables(tables) if tables else None


def _numbers(*arrays: np.ndarray) -> bytes:
    """Arrays as differences of neighbours, compressed."""
    return zlib.compress(b"".join(np.diff(a.astype(np.int64), prepend=0).astype("<i8").tobytes() for a in arrays), 1)


def _array(raw: bytes, n: int) -> list[np.ndarray]:
    return [np.cumsum(x) for x in np.frombuffer(zlib.decompress(raw), "<i8").reshape(n, -1)]


# Step 1: anchors that occur in two documents


def _hash_runs(docs: DataFrame, length: int, gram: int, bits: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = serial = 0
        now: int | None = None

        def flush() -> pa.RecordBatch:
            hashes = np.concatenate([h for h, _ in held]) >> U64(32 - bits)
            docs_of = np.concatenate([d for _, d in held])
            order = np.lexsort((docs_of, hashes))
            hashes, docs_of = hashes[order], docs_of[order]
            first = np.concatenate([[True], hashes[1:] != hashes[:-1]])
            at = np.flatnonzero(first)
            own = hashes[at]
            fresh = np.concatenate([[True], (docs_of[1:] != docs_of[:-1]) | first[1:]])
            docs_n = np.minimum(np.add.reduceat(fresh.astype(np.int64), at), 255).astype(np.uint8)
            buckets = (own >> U64(32)).astype(np.int64)
            cut = np.concatenate([[0], np.flatnonzero(buckets[1:] != buckets[:-1]) + 1, [len(own)]])
            rows = [(int(buckets[a]), now, own[a:b].astype(np.uint32).tobytes(), docs_n[a:b].tobytes()) for a, b in zip(cut[:-1], cut[1:], strict=True)]
            columns = list(zip(*rows, strict=True))
            types = [pa.int32(), pa.int64(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["bucket", "file", "hashes", "docs"])

        for batch in batches:
            for file, rows in _by_file(batch):
                if size and file != now:
                    yield flush()
                    held, size = [], 0
                now = file
                for _, row, _, _, hashes, *_ in _anchored(rows.column(3), length, gram):
                    held.append((hashes, serial + row))
                    size += len(hashes)
                    if size > HELD:
                        yield flush()
                        held, size = [], 0
                serial += len(rows)
        if size:
            yield flush()
        held.clear()
        release()

    return docs.mapInArrow(run, "bucket int, file long, hashes binary, docs binary")


def _shared_hashes(runs: DataFrame) -> DataFrame:
    def meet(group: pa.Table) -> pa.Table:
        hashes = [np.frombuffer(h.as_buffer(), np.uint32) for h in group.column("hashes")]
        docs_n = np.concatenate([np.frombuffer(s.as_buffer(), np.uint8) for s in group.column("docs")])
        flat = np.concatenate(hashes)
        order = np.argsort(flat, kind="stable")
        ordered = flat[order]
        at = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        total = np.add.reduceat(docs_n[order].astype(np.int64), at)
        wanted = ordered[at][total > 1]
        hot = total[total > 1] > HOT
        files, bucket = group.column("file").to_pylist(), group.column("bucket")[0].as_py()
        out: dict[int, list[np.ndarray]] = {}
        for f, h in zip(files, hashes, strict=True):
            if len(wanted):
                place = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
                if len(hit := place[wanted[place] == h]):
                    out.setdefault(f, []).append(hit)
        rows = []
        for f, v in out.items():
            own = np.unique(np.concatenate(v))
            rows.append((f, bucket, wanted[own].tobytes(), np.packbits(hot[own]).tobytes()))
        columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
        types = [pa.int64(), pa.int32(), pa.binary(), pa.binary()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["file", "bucket", "hashes", "hot"])

    return runs.groupBy("bucket").applyInArrow(meet, "file long, bucket int, hashes binary, hot binary")


# Step 2: front-coded sorted runs


def sorted_order(matrix: np.ndarray) -> np.ndarray:
    """The order of the rows of a matrix of bytes, as byte strings."""
    rows, width = matrix.shape
    wide = np.zeros((rows, -(-width // 8) * 8), np.uint8)
    wide[:, :width] = matrix
    words = wide.view(">u8").astype(np.uint64)
    return np.lexsort(tuple(words[:, k] for k in range(words.shape[1] - 1, -1, -1)))


def shared_lengths(matrix: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Of each row, the length of the prefix it shares with the row before, within both lengths."""
    if not len(matrix):
        return np.zeros(0, np.int64)
    differ = matrix[1:] != matrix[:-1]
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), matrix.shape[1])
    return np.concatenate([[0], np.minimum(first, np.minimum(lens[1:], lens[:-1]))])


def front_code(matrix: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Shared lengths and the concatenated rests of sorted rows."""
    shared = shared_lengths(matrix, lens)
    column = np.arange(matrix.shape[1])
    return shared, matrix[(column >= shared[:, None]) & (column < lens[:, None])].tobytes()


def front_decode(shared: list[int], lens: list[int], rests: bytes) -> Iterator[bytes]:
    before, at = b"", 0
    for s, n in zip(shared, lens, strict=True):
        end = at + n - s
        before = before[:s] + rests[at:end]
        yield before
        at = end


def _surroundings(part: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Right and left sides of anchors as matrices padded with zeros, the left ones read backwards, and their lengths."""
    right_n = np.minimum(high - at, length)
    left_n = np.minimum(at - low, length - gram)
    width = length - gram
    view = np.lib.stride_tricks.sliding_window_view
    right = view(np.concatenate([part, np.zeros(length, np.uint8)]), length)[at]
    right[np.arange(length) >= right_n[:, None]] = 0
    left = view(np.concatenate([np.zeros(width, np.uint8), part]), width)[at][:, ::-1].copy()
    left[np.arange(width) >= left_n[:, None]] = 0
    return right, right_n, left, left_n


def _windows(part: np.ndarray, rows: np.ndarray, places: np.ndarray, at: np.ndarray, first: np.ndarray, windows: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """The windows of some anchors as suffixes of their own, with nothing to the left: hashes, rows, places, sides."""
    which = np.repeat(np.arange(len(at)), windows)
    begin = first[which] + np.arange(len(which)) - np.repeat(np.cumsum(windows) - windows, windows)
    sides = _surroundings(part, begin, begin, begin + length, length, gram)
    width = -(-length // 8) * 8
    words = np.zeros((len(begin), width), np.uint8)
    words[:, :length] = sides[0]
    hashes = np.zeros(len(begin), np.uint64)
    for word in words.view("<u8").T:
        hashes = mix(hashes * U64(_BASE) + word)
    return hashes, rows[which], places[which] + begin - at[which], *sides


def _suffix_runs(docs: DataFrame, shared_path: str, length: int, gram: int, bits: int) -> DataFrame:
    names = ["bucket", "file", "n", "numbers", "rests", "lefts", "covered"]
    types = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]

    def sort(held: list[tuple], file: int) -> pa.RecordBatch:
        """A run for each bucket."""
        hashes, *held_columns = (np.concatenate(x) for x in zip(*held, strict=True))
        buckets = (hashes >> U64(64 - bits)).astype(np.int64)
        by_bucket = np.argsort(buckets, kind="stable")
        cuts = np.flatnonzero(np.diff(buckets[by_bucket], prepend=-1, append=1 << bits))
        out = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            own = by_bucket[a:b]
            i, w, p, r, rn, f, fn = (x[own] for x in held_columns)
            # Sort by right side, then left side, lengths, and id.
            both = np.concatenate([r, rn[:, None].astype(np.uint8), f, fn[:, None].astype(np.uint8), (i - np.iinfo(np.int64).min).astype(np.uint64).astype(">u8")[:, None].view(np.uint8)], axis=1)
            order = sorted_order(both)
            i, w, p, r, rn, f, fn = (x[order] for x in (i, w, p, r, rn, f, fn))
            around = both[order][:, :-8]
            first = np.concatenate([[True], (around[1:] != around[:-1]).any(axis=1)])
            late = i > i[np.flatnonzero(first)][np.cumsum(first) - 1]
            done = late & (rn + fn >= length)
            covered = _numbers(w[done], (p - fn)[done], (p + rn)[done]) if done.any() else None
            i, w, p, r, rn, f, fn = (x[~late] for x in (i, w, p, r, rn, f, fn))
            shared, rests = front_code(r, rn)
            lefts = f[np.arange(length - gram) < fn[:, None]].tobytes()
            out.append((int(buckets[own[0]]), file, len(i), _numbers(shared, rn, fn, i, w, p), rests, lefts, covered))
        columns = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, wanted, hot = -1, np.zeros(0, np.uint64), np.zeros(0, bool)
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for file, rows in _by_file(batch):
                if file != now:
                    if size:
                        yield sort(held, now)
                        held, size = [], 0
                    now, found = file, _written(shared_path, file)
                    wanted, hot = _wanted(found)
                ids = rows.column(2).fill_null(NO_ID).to_numpy()
                index = rows.column(1).to_numpy()
                for part, row, place, at, hashes, low, high, first, windows in _anchored(rows.column(3), length, gram):
                    if not len(wanted) or not len(hashes):
                        continue
                    keys = hashes >> U64(32 - bits)
                    known = np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)
                    keep = wanted[known] == keys
                    split = np.flatnonzero(keep & hot[known])
                    keep = np.flatnonzero(keep & ~hot[known])
                    for k in range(0, len(keep), HELD_SUFFIXES):
                        k = keep[k : k + HELD_SUFFIXES]
                        held.append((hashes[k], ids[row[k]], index[row[k]], place[k], *_surroundings(part, at[k], low[k], high[k], length, gram)))
                        size += len(k)
                        if size > HELD_SUFFIXES:
                            yield sort(held, now)
                            held, size = [], 0
                    for k in range(0, len(split), HELD_SUFFIXES >> 4):
                        k = split[k : k + (HELD_SUFFIXES >> 4)]
                        own, of, places, *sides = _windows(part, row[k], place[k], at[k], first[k], windows[k], length, gram)
                        held.append((own, ids[of], index[of], places, *sides))
                        size += len(own)
                        if size > HELD_SUFFIXES:
                            yield sort(held, now)
                            held, size = [], 0
        if size:
            yield sort(held, now)
        held.clear()
        release()

    return docs.mapInArrow(run, "bucket int, file long, n int, numbers binary, rests binary, lefts binary, covered binary")


def _wanted(found: pa.Table | None) -> tuple[np.ndarray, np.ndarray]:
    """The sorted hashes of a file's anchors that other documents share, and which of them are hot."""
    if found is None:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    keys, hot = [], []
    for bucket, h, marks in zip(found.column("bucket").to_pylist(), found.column("hashes"), found.column("hot"), strict=True):
        keys.append(np.frombuffer(h.as_buffer(), np.uint32).astype(np.uint64) | U64(bucket << 32))
        hot.append(np.unpackbits(np.frombuffer(marks.as_buffer(), np.uint8))[: len(keys[-1])].astype(bool))
    wanted = np.concatenate(keys)
    order = np.argsort(wanted)
    return wanted[order], np.concatenate(hot)[order]


# Step 3: the merge


def merge_runs(runs: list[tuple[Iterable[bytes], list[int]]]) -> tuple[list[tuple[int, int]], list[int]]:
    """Merges sorted runs of strings, each with its shared lengths; gives (run, position) in order and the shared lengths.
    Of each run one string is held at a time.

    A loser tree: each inner node keeps the loser of its match and the length of the prefix that the loser shares with the
    last winner to pass there. A contender that shares more with the last output is the smaller one; only of equals are
    further bytes compared."""
    k = 1
    while k < len(runs):
        k *= 2
    strings = [iter(r[0]) for r in runs] + [iter(())] * (k - len(runs))
    lengths = [r[1] for r in runs] + [[]] * (k - len(runs))
    now_at = [next(x, b"") for x in strings]
    heads = [0] * k
    loser, shared = [0] * k, [0] * k

    def play(a: int, la: int, b: int, lb: int) -> tuple[int, int, int, int]:
        """Winner and loser with their lengths; a run at its end, with length -1, loses."""
        if la != lb:
            return (a, la, b, lb) if la > lb else (b, lb, a, la)
        if la < 0:
            return a, la, b, lb
        x, y = now_at[a], now_at[b]
        if x == y:
            return (a, la, b, len(x)) if a < b else (b, lb, a, len(x))
        i, end = la, min(len(x), len(y))
        step = 8
        while i < end and x[i : i + step] == y[i : i + step]:
            i += step
        i = min(i, end)
        while i < end and x[i] == y[i]:
            i += 1
        if i == len(x) or (i < len(y) and x[i] < y[i]):
            return a, la, b, i
        return b, lb, a, i

    def build(node: int) -> tuple[int, int]:
        if node >= k:
            run = node - k
            return run, 0 if lengths[run] else -1
        w, lw, loser[node], shared[node] = play(*build(2 * node), *build(2 * node + 1))
        return w, lw

    order: list[tuple[int, int]] = []
    out: list[int] = []
    winner, length = build(1) if k > 1 else (0, 0 if lengths[0] else -1)
    while length >= 0:
        at = heads[winner]
        order.append((winner, at))
        out.append(length)
        at += 1
        heads[winner] = at
        run, now = winner, -1
        if at < len(lengths[winner]):
            now_at[winner], now = next(strings[winner]), lengths[winner][at]
        node = (run + k) >> 1
        while node:
            other, theirs = loser[node], shared[node]
            if now > theirs:
                pass
            elif now < theirs:
                loser[node], shared[node], run, now = run, now, other, theirs
            elif now >= 0:
                run, now, loser[node], shared[node] = play(run, now, other, theirs)
            node >>= 1
        winner, length = run, now
    return order, out


# Step 4: classes of equal windows


def covered_ranges(right_shared: np.ndarray, right_n: np.ndarray, left: np.ndarray, left_n: np.ndarray, ids: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each suffix, in merged order, the range of bytes around its anchor that lie in windows of a smaller document:
    first and last number of bytes right of the anchor at which such a window ends; (1, 0) if there is none."""
    n = len(ids)
    by_left = sorted_order(np.concatenate([left, left_n[:, None].astype(np.uint8)], axis=1))
    left_shared = shared_lengths(left[by_left], left_n[by_left])
    first, last = np.full(n, length + 1), np.zeros(n, np.int64)
    left_class = np.empty(n, np.int64)
    for t in range(gram, length + 1):
        able = np.flatnonzero((right_n >= t) & (left_n >= length - t))
        if len(able) < 2:
            continue
        right_class = np.cumsum(right_shared < t)
        left_class[by_left] = np.cumsum(left_shared < length - t)
        key = right_class[able] * (n + 1) + left_class[able]
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        at = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        least = np.minimum.reduceat(ids[able][order], at)
        least = np.repeat(least, np.diff(np.concatenate([at, [len(ordered)]])))
        late = able[order[ids[able][order] > least]]
        first[late] = np.minimum(first[late], t)
        last[late] = t
    return first, last


def _merge(runs: DataFrame, length: int, gram: int) -> DataFrame:
    width = length - gram

    def meet(group: pa.Table) -> pa.Table:
        numbers, strings, files, lefts = [], [], [], []
        out: list[tuple[int, bytes]] = []
        for file, raw, rests, left, done in zip(*(group.column(c) for c in ("file", "numbers", "rests", "lefts", "covered")), strict=True):
            shared, rn, fn, ids, rows, places = _array(raw.as_buffer(), 6)
            shared = shared.tolist()
            strings.append((front_decode(shared, rn.tolist(), memoryview(rests.as_buffer())), shared))
            own = np.zeros((len(ids), width), np.uint8)
            own[np.arange(width) < fn[:, None]] = np.frombuffer(left.as_buffer(), np.uint8)
            lefts.append(own)
            numbers.append(np.stack([rn, fn, ids, rows, places]))
            files.append(np.full(len(ids), file.as_py()))
            if done.is_valid:
                out.append((file.as_py(), done.as_py()))
        order, shared = merge_runs(strings)
        start = np.cumsum([0, *(len(n) for _, n in strings)])
        at = np.array([start[r] + p for r, p in order], np.int64)
        del order
        rn, fn, ids, rows, places = np.concatenate(numbers, axis=1)[:, at]
        of_file = np.concatenate(files)[at]
        first, last = covered_ranges(np.array(shared, np.int64), rn, np.concatenate(lefts)[at], fn, ids, length, gram)
        hit = np.flatnonzero(first <= last)
        for f in np.unique(of_file[hit]).tolist():
            own = hit[of_file[hit] == f]
            s, e = places[own] + first[own] - length, places[own] + last[own]
            o = np.lexsort((s, rows[own]))
            out.append((f, _numbers(rows[own][o], s[o], e[o])))
        columns = list(zip(*out, strict=True)) or [(), ()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.binary()], strict=True)], ["file", "covered"])

    return runs.groupBy("bucket").applyInArrow(meet, "file long, covered binary")


# Step 5: the cut


def _cut(rows: DataFrame, covered_path: str, finish, schema: StructType) -> DataFrame:
    """finish: gets a batch and the ranges to remove of each row, and returns a batch of ``schema``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows_of, spans = -1, np.zeros(0, np.int64), np.zeros((2, 0), np.int64)
        for batch in batches:
            for file, part in _by_file(batch):
                if file != now:
                    now, found = file, _written(covered_path, file)
                    rows_of, spans = np.zeros(0, np.int64), np.zeros((2, 0), np.int64)
                    if found is not None:
                        every = np.concatenate([np.stack(_array(c.as_buffer(), 3)) for c in found.column("covered")], axis=1)
                        every = every[:, np.lexsort((every[1], every[0]))]
                        rows_of, spans = every[0], every[1:]
                for k in range(0, len(part), 256):
                    some = part.slice(k, 256)
                    index = some.column(1).to_numpy()
                    lows, highs = np.searchsorted(rows_of, index), np.searchsorted(rows_of, index, side="right")
                    yield finish(some, [unite(spans[0, a:b], spans[1, a:b]) for a, b in zip(lows, highs, strict=True)])

    return rows.mapInArrow(run, schema)


def unite(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of the ranges, which are sorted by start."""
    if not len(starts):
        return []
    reach = np.maximum.accumulate(ends)
    fresh = np.flatnonzero(np.concatenate([[True], starts[1:] > reach[:-1]]))
    return list(zip(starts[fresh].tolist(), reach[np.concatenate([fresh[1:], [len(starts)]]) - 1].tolist(), strict=True))


#: Where a written row lies: files are numbered by task and by file of the task, so that no two share a number.
_FILE = r"^part-(\d+)-.*-c(\d+)[.]"


def covered(docs: DataFrame, id_col: str, text_col: str, length: int = LENGTH, gram: int = GRAM) -> tuple[DataFrame, str]:
    """The copied rows (file, row, id, text, the other columns as ``rest``) and the path of the written table of covered
    ranges by file."""
    spark = docs.sparkSession
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    copy = materialise(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.struct(*rest).alias("rest")), "texts")
    task, of_task = (F.regexp_extract("_metadata.file_name", _FILE, k).cast("long") for k in (1, 2))
    file = F.when(of_task < 1 << 20, task * (1 << 20) + of_task).otherwise(F.raise_error(F.concat(F.lit("no number in "), "_metadata.file_name")).cast("long"))
    rows = copy.select(file.alias("file"), F.col("_metadata.row_index").alias("row"), "id", "text", "rest")
    parts = shuffle_partitions(spark)
    bits = max(4, (BUCKETS * parts - 1).bit_length())
    shared_path, covered_path = fresh_path(spark, "shared-hashes"), fresh_path(spark, "covered")
    slim = rows.drop("rest")
    _shared_hashes(_hash_runs(slim, length, gram, bits)).repartition(parts, "file").write.partitionBy("file").parquet(shared_path)
    _merge(_suffix_runs(slim, shared_path, length, gram, bits), length, gram).repartition(parts, "file").write.partitionBy("file").parquet(covered_path)
    discard(spark, shared_path)
    return rows, covered_path


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, spans_col: str = "spans") -> DataFrame:
    """All columns of ``docs``, the text's remaining bytes as binary (a cut may fall inside a character; a null stays null),
    and ``spans``: the maximal removed runs, as bytes of the UTF-8 text, end exclusive."""
    if spans_col in docs.columns:
        raise ValueError(f"there is a column {spans_col!r} already: name another by spans_col")
    rows, path = covered(docs, id_col, text_col, length)
    others = [c for c in docs.columns if c != text_col]
    fields = [StructField(f.name, BinaryType() if f.name == text_col else f.dataType) for f in docs.schema]
    span = StructType([StructField("start", LongType()), StructField("end", LongType())])

    def finish(batch: pa.RecordBatch, spans: list[list[tuple[int, int]]]) -> pa.RecordBatch:
        kept = [None if t is None else cut_out(t.encode(), s) for t, s in zip(batch.column(3).to_pylist(), spans, strict=True)]
        columns = dict(zip(others, batch.column(4).flatten(), strict=True)) | {text_col: pa.array(kept, pa.binary())}
        flat = np.array([x for s in spans for x in s], np.int64).reshape(-1, 2)
        each = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["start", "end"])
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, spans)]), pa.int32()), each)
        return pa.RecordBatch.from_arrays([*(columns[c] for c in docs_columns), lists], [*docs_columns, spans_col])

    docs_columns = docs.columns
    return _cut(rows, path, finish, StructType([*fields, StructField(spans_col, ArrayType(span, False), False)]))


def cut_out(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for s in spans for x in s), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """id, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` of every row, from what :func:`clean` gives."""
    done = clean(docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("text")), id_col, "text", length)
    cut = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    kept = F.coalesce("text", F.lit("").cast("binary"))
    return done.select(
        id_col, (F.octet_length(kept) + cut).alias("n_bytes"), cut.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2(kept, 256).alias("kept_sha256")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(table(spark, sf_dir, "documents"))
