"""Documents whose sets of word shingles are similar, by a grouped prefix join, and their connected components.

1. Shingles get a global order: rare ones first, by two tables of counters of fixed size, then by hash. Any order that is
   the same for all documents gives right results; this one keeps common phrases (by their words' numbers) and shared lines
   (by their own) out of the prefixes.
2. Documents with equal sets collapse into one class, classes with equal prefixes and sizes into one group.
3. Group pairs that share a prefix shingle are filtered by size and by the positions of that shingle. Of shingles that
   stand in exactly the same prefixes, as those of a shared passage do, only the first in the order lists its groups: the
   first shingle that two prefixes share is never one of those left out.
4. Members are verified on their whole sets. First each group is compared only with one other of every shingle's list, and
   the links found are joined into components. Then all pairs between different components are compared by sizes, positions
   and signatures where they stand, large lists in cells of two blocks each: for some rounds only a spanning forest of the
   likeliest of a cell's pairs is verified, fewer than the cell has rows, and its links are joined; at last all pairs still
   left that may link are. A family of thousands of near copies thus costs a few rows for each instead of all its pairs,
   and no link that would join two components is lost.

A document's set holds 64-bit hashes of its shingles; sizes and overlaps are exact but for collisions (about 1 in 10^12
for a pair of documents of a thousand words).

Defined results: a null text, and one without words, has the empty set and is its own component; a text with fewer words
than a shingle has its whole sequence as one; equal sets link; rows repeated with one id and text are each returned; an id
with several texts may also link by any of them; rows with a null id are returned as they are, unlinked; an empty
table gives an empty result; other columns are neither read nor returned, and all pass through :func:`keep_one`.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, doc_chunks, materialise, release, table, utf8_view
from .components import components
from .wordhash import SPACES, U64, shingle_hashes, word_bounds, word_hashes

#: The counters of the order: two tables of 4 million, of one byte each when sent to the executors.
COUNTER_BITS = 22
CHUNK_BITS = 16
#: Map tasks' counters meet in so many groups for each chunk before they meet in one.
COUNT_SALTS = 16
#: Rounds of spanning forests before all remaining pairs are verified, the last one where so few of its pairs did not link;
#: they change the cost, not the result.
FOREST_ROUNDS = 3
FEW_UNLINKED = 10_000
#: Words of 64 bits in a set's signature: the parities of how many of its shingles fall on each bit.
SIGNATURE = 8
MARKS = [f"mark{k}" for k in range(SIGNATURE)]
#: Rows of a list that meet in one cell, on either side; and a row's lists that it remembers.
BLOCK = 1024
BEFORE = 16
#: Rows, or pairs, that a task holds besides one cell, and those it compares at a time.
HELD_ROWS = 1 << 15
STEP_ROWS = 1 << 13
#: Pairs that a task holds, besides those of a forest, before it cuts them to a forest.
HELD_PAIRS = 1 << 18
#: Ranks from here on are those of shingles that stand out by their own number.
COMMON = 1 << 15


def least_overlap(nx, ny, percent: int):
    """The smallest overlap at which sets of these sizes link: 100 i >= percent * (nx + ny - i)."""
    return -(-percent * (nx + ny) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    """A linked partner overlaps a set of size n in ``ceil(percent n / 100)`` at least, so in one of the first so many."""
    return n - -(-percent * n // 100) + 1


def document_hashes(column: pa.Array, words: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The hashes of each text's words and of its shingles, in order."""
    buf, offsets = utf8_view(column)
    for i, j in doc_chunks(offsets):
        part, offs = buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        starts, ends = word_bounds(part, offs, SPACES)
        hashes = word_hashes(part, starts, ends)
        at = np.searchsorted(starts, offs)
        for d in range(j - i):
            own = hashes[at[d] : at[d + 1]]
            yield own, shingle_hashes(own, words)


def document_sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The sorted set of shingle hashes of each text."""
    for _, shingles in document_hashes(column, words):
        yield np.unique(shingles)


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> U64(64 - COUNTER_BITS)).astype(np.int64)


def _counters(docs: DataFrame, words: int) -> tuple[bytes, bytes]:
    """Of the words and of the shingles of all documents: one byte for each counter, a logarithm of how many fall on it."""
    n = 1 << COUNTER_BITS
    chunks = 1 << (COUNTER_BITS - CHUNK_BITS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, n), np.uint32)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def settle() -> None:
            for k in (0, 1):
                at, times = np.unique(_slots(np.concatenate([h[k] for h in held])), return_counts=True)
                counts[k, at] += times.astype(np.uint32)

        for batch in batches:
            for hashes, shingles in document_hashes(batch.column(0), words):
                held.append((hashes, np.unique(shingles)))
                size += len(hashes)
                if size > 1 << 18:
                    settle()
                    held, size = [], 0
        if held:
            settle()
        if counts.any():
            parts = [zlib.compress(p.tobytes(), 1) for p in np.split(counts.reshape(-1), 2 * chunks)]
            yield pa.RecordBatch.from_arrays([pa.array(range(2 * chunks), pa.int32()), pa.array(parts, pa.binary())], ["chunk", "counts"])
        del counts
        release()

    def summed(parts: Iterator[pa.RecordBatch]) -> tuple[int, np.ndarray]:
        """Batch by batch, so that a task holds one chunk's sum however many tasks have counted."""
        total, chunk = np.zeros(1 << CHUNK_BITS, np.int64), 0
        for part in parts:
            chunk = part.column("chunk")[0].as_py()
            for p in part.column("counts"):
                total += np.frombuffer(zlib.decompress(p.as_buffer()), np.uint32)
        return chunk, total

    def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, total = summed(parts)
        raw = zlib.compress(np.minimum(total, np.iinfo(np.uint32).max).astype(np.uint32).tobytes(), 1)
        yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([raw], pa.binary())], ["chunk", "counts"])

    def judge(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, total = summed(parts)
        rank = np.floor(6 * np.log2(np.maximum(total, 1))).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([zlib.compress(rank.tobytes())], pa.binary())], ["chunk", "rank"])

    counted = docs.select("text").mapInArrow(count, "chunk int, counts binary").withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(COUNT_SALTS)))
    partly = counted.groupBy("chunk", "_salt").applyInArrow(add, "chunk int, counts binary")
    rows = partly.groupBy("chunk").applyInArrow(judge, "chunk int, rank binary")
    out = np.zeros(2 * n, np.uint8)
    for r in rows.collect():  # 128 rows of 64 KB at most
        out[r["chunk"] << CHUNK_BITS : (r["chunk"] + 1) << CHUNK_BITS] = np.frombuffer(zlib.decompress(bytes(r["rank"])), np.uint8)
    return out[:n].tobytes(), out[n:].tobytes()


def signature(s: np.ndarray) -> np.ndarray:
    """Sets whose signatures differ in k bits differ in k shingles at least: each shingle that only one has flips one bit."""
    bits = np.bincount((s >> U64(24)).astype(np.int64) & (64 * SIGNATURE - 1), minlength=64 * SIGNATURE) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def shingle_ranks(hashes: np.ndarray, shingles: np.ndarray, words: int, of_words: np.ndarray, of_shingles: np.ndarray, usual: float) -> np.ndarray:
    """How common each shingle is: the sum of its words' logarithms, as if words met by chance; but where its own counter
    stands out above the usual one, that counter's."""
    by_word = of_words[_slots(hashes)].astype(np.int64)
    if len(hashes) < words:
        chance = by_word.sum(keepdims=True)
    else:
        chance = by_word[: len(shingles)].copy()
        for k in range(1, words):
            chance += by_word[k : k + len(shingles)]
    own = of_shingles[_slots(shingles)].astype(np.int64)
    return np.where(own > usual, COMMON + own, np.minimum(chance, COMMON - 1))


def _profiles(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """``id, n, digest, key, prefix``: set size, digests of the set and of its prefix, and the prefix, rarest first."""
    tables = docs.sparkSession.sparkContext.broadcast(_counters(docs, words))
    id_type = docs.schema["id"].dataType.simpleString()

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_words, of_shingles = (np.frombuffer(t, np.uint8) for t in tables.value)
        mean = (np.bincount(of_shingles, minlength=256) * np.exp2(np.arange(256) / 6.0)).sum() / len(of_shingles)
        usual = 6 * np.log2(mean + 4 * mean**0.5 + 4)
        for batch in batches:
            sizes, digests, keys, prefixes, marks = [], [], [], [], []
            for hashes, shingles in document_hashes(batch.column(1), words):
                s, at = np.unique(shingles, return_index=True)
                sizes.append(len(s))
                marks.append(signature(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                first = np.zeros(0, np.uint64)
                if len(s):
                    rank = shingle_ranks(hashes, shingles, words, of_words, of_shingles, usual)[at]
                    order = rank.astype(np.uint64) << U64(48) | s >> U64(16)
                    p = prefix_length(len(s), percent)
                    some = np.argpartition(order, p - 1)[:p] if p < len(s) else np.arange(len(s))
                    first = s[some[np.lexsort((s[some], order[some]))]]
                keys.append(hashlib.blake2b(first.tobytes(), digest_size=16).digest())
                prefixes.append(first.view(np.int64))
            offs = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32)
            tokens = pa.ListArray.from_arrays(pa.array(offs), pa.array(np.concatenate([*prefixes, np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), pa.array(digests, pa.binary()), pa.array(keys, pa.binary()), tokens, *map(pa.array, np.stack(marks).T if marks else np.zeros((SIGNATURE, 0), np.int64))], ["id", "n", "digest", "key", "prefix", *MARKS])
        release()

    return docs.select("id", "text").mapInArrow(profile, f"id {id_type}, n int, digest binary, key binary, prefix array<long>, " + ", ".join(f"{m} long" for m in MARKS))


def _verify(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose sets link, each set built again from the whole text."""
    pairs = materialise(pairs, "pairs")
    # Written, so that its size is known: texts are shuffled only if the ids are too many to be sent along.
    wanted = materialise(pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id"))).distinct(), "wanted")
    sets = materialise(_sets(docs.where("id is not null").join(wanted, "id", "left_semi"), words), "sets")
    joined = (
        pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a")
        .join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b")
        .select("a", "b", "sa", "sb")
    )

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                keep.append(int((y[at] == x).sum()) >= least_overlap(len(x), len(y), percent))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    t = pairs.schema["a"].dataType.simpleString()
    return materialise(joined.mapInArrow(check, f"a {t}, b {t}").distinct(), "links")


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """id, ``n_shingles``, ``component_id`` of every row."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    profiles = materialise(_profiles(docs, words, percent), "profiles")
    known = profiles.where("n > 0 and id is not null")

    # Equal sets are one class, named by its smallest id; classes with equal prefixes and sizes are one group.
    classes = materialise(known.groupBy("digest", "key", "n").agg(F.min("id").alias("cls"), *(F.first(m).alias(m) for m in MARKS)), "classes")
    groups = materialise(classes.groupBy("key", "n").agg(F.min("cls").alias("gid"), F.count(F.lit(1)).alias("size")), "groups")
    many = groups.where("size > 1").select("key", "n", "gid")
    members = materialise(classes.join(many, ["key", "n"]).select("gid", "cls", "n", F.xxhash64("gid", "key").alias("src")), "members")  # of groups of two and more

    # The lists of prefix shingles; a row stays only if the next larger or smaller group is of a size that could link.
    by_id = known.select("id", "key", "n", "prefix").join(groups.select(F.col("gid").alias("id"), "key", "n"), ["id", "key", "n"]).dropDuplicates(["id", "key"])
    tokens = by_id.select(F.col("id").alias("gid"), "n", F.xxhash64("id", "key").alias("row"), F.xxhash64("id", "key").alias("src"), F.posexplode("prefix").alias("pos", "tok"))
    inside = members.select(F.col("cls").alias("gid"), "n", F.xxhash64("cls", "n").alias("row"), "src", F.lit(0).alias("pos"), F.xxhash64(F.lit("group"), "gid").alias("tok"))
    by_size = Window.partitionBy("tok").orderBy("n", "gid")
    tokens = tokens.unionAll(inside).select("*", *(f("n").over(by_size).alias(f"{w}_n") for w, f in (("prev", F.lag), ("next", F.lead))))
    could = lambda m: F.least("n", m) * (100 + percent) >= (F.col("n") + F.col(m)) * percent
    every = materialise(tokens.where(could("prev_n") | could("next_n")).select("tok", "gid", "n", "pos", "row", "src"), "tokens")

    # Shingles with equal lists (by number and two hashes of the rows): in any of the list's rows, the first of them stands first.
    of_list = every.groupBy("tok").agg(
        F.count(F.lit(1)).alias("k"), F.bit_xor("row").alias("x"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("y"), F.min(F.struct("row", "pos")).alias("at")
    )
    stays = of_list.groupBy("k", "x", "y", "at.row").agg(F.min_by("tok", F.struct("at.pos", "tok")).alias("tok")).select("tok")
    tokens = materialise(every.join(stays, "tok", "left_semi").drop("row"), "tokens")

    def fits(n1, p1, n2, p2) -> F.Column:
        bound = F.least(F.least(n1 - p1, n2 - p2), F.least(n1, n2))
        return bound * (100 + percent) >= (n1 + n2) * percent

    # First pairs: every group with the smallest one in the list, or with its neighbour by size where that cannot link.
    whole = Window.partitionBy("tok")
    least = F.min(F.struct("gid", "n", "pos")).over(whole)
    near = F.struct(*(F.lag(c).over(by_size).alias(c) for c in ("gid", "n", "pos")))
    listed = tokens.select(F.col("gid").alias("a"), "n", "pos", least.alias("least"), near.alias("near"))
    ok = lambda o: F.col(f"{o}.gid").isNotNull() & (F.col(f"{o}.gid") != F.col("a")) & fits(F.col("n"), F.col("pos"), F.col(f"{o}.n"), F.col(f"{o}.pos"))
    other = F.when(ok("least"), F.col("least.gid")).when(ok("near"), F.col("near.gid"))
    pairs = listed.select("a", other.alias("o")).where("o is not null").select(F.least("a", "o").alias("a"), F.greatest("a", "o").alias("b"))
    pairs = materialise(pairs.distinct(), "pairs")
    links = _verify(pairs, docs, words, percent)
    first = materialise(components(links, "a", "b"), "components")

    # Rounds of spanning forests: of every cell's pairs in different components, those that could join the most.
    marked = classes.select("cls", "n", *MARKS).distinct()
    tried, nodes = pairs, first
    for _ in range(FOREST_ROUNDS):
        rest = materialise(_remaining(_listed(tokens, members, nodes).join(marked, ["cls", "n"], "left"), percent, forest=True).join(tried, ["a", "b"], "left_anti"), "pairs")
        more = _verify(rest, docs, words, percent)
        tried = tried.unionAll(rest)
        found = more.count()
        if found:
            nodes = materialise(components(nodes.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(more), "a", "b"), "components")
        if not found or rest.count() - found < FEW_UNLINKED:
            break

    # What is left: all pairs in one list whose members are in different components, each at its first common shingle.
    rest = _remaining(_listed(tokens, members, nodes).join(marked, ["cls", "n"], "left"), percent).join(tried, ["a", "b"], "left_anti")
    more = _verify(rest, docs, words, percent)
    joined = components(nodes.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(more), "a", "b")

    roots = classes.select("digest", "cls").join(joined.withColumnRenamed("node", "cls"), "cls", "left").select("digest", F.coalesce("component", "cls").alias("component"))
    out = profiles.select("id", "n", F.when(F.col("n") > 0, F.col("digest")).alias("digest")).join(roots, "digest", "left")
    return out.select(
        F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id")
    )


def _listed(tokens: DataFrame, members: DataFrame, nodes: DataFrame) -> DataFrame:
    """The lists with every member of a group, and its component so far: ``tok, cls, n, pos, src, component``."""
    rows = tokens.join(members.select("gid", F.col("cls").alias("member")), "gid", "left").select("tok", F.coalesce("member", "gid").alias("cls"), "n", "pos", "src").distinct()
    return rows.join(nodes.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))


def _remaining(listed: DataFrame, percent: int, forest: bool = False) -> DataFrame:
    """Pairs ``a, b`` of one list and different components that sizes, positions and signatures let link: all of them, or
    of each cell only a spanning forest of the components that they join.

    Lists of more than ``BLOCK`` rows are dealt into blocks, and every two blocks meet in a cell of their own: a component
    of more rows than that has blocks to itself, which do not meet one another. A cell's pairs are compared where they
    stand, so only those that may link are ever rows.
    """
    listed = materialise(listed, "listed")
    lists = listed.groupBy("tok").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.count(F.lit(1)).alias("k"))
    lists = materialise(lists.where("c0 < c1").select("tok", "k"), "lists")
    # Both members of a pair know their last few lists before this one: a pair that met there is not made again here.
    earlier = Window.partitionBy("cls", "src", "n", *MARKS).orderBy("pos", "tok").rowsBetween(-BEFORE, -1)
    rows = materialise(listed.join(lists, "tok").withColumn("before", F.collect_list("tok").over(earlier)).drop("src"), "rows")

    hot = rows.where(F.col("k") > BLOCK)
    sizes = hot.groupBy("tok", "component").agg(F.count(F.lit(1)).alias("c"))
    small = sizes.where(F.col("c") <= BLOCK).groupBy("tok").agg(F.sum("c").alias("smalls"))
    large = sizes.where(F.col("c") > BLOCK)
    placed = hot.join(large, ["tok", "component"], "left").join(small, "tok", "left")
    own = F.col("c").isNotNull()
    placed = placed.withColumn("home", F.when(own, F.xxhash64("component")).otherwise(F.lit(0)))
    dealt = F.when(own, F.pmod(F.xxhash64("cls"), F.ceil(F.col("c") / BLOCK))).otherwise(F.pmod(F.xxhash64("component"), F.ceil(F.col("smalls") / BLOCK)))
    placed = materialise(placed.withColumn("at", F.struct("home", dealt.alias("salt"))).drop("home", "c", "smalls"), "placed")
    blocks = placed.select("tok", "at").distinct()
    cells = blocks.withColumnRenamed("at", "one").join(blocks.withColumnRenamed("at", "two"), "tok").where((F.col("one") <= F.col("two")) & ((F.col("one.home") != F.col("two.home")) | (F.col("one.home") == 0)))
    cells = materialise(cells.select("tok", "one", "two", F.xxhash64("one", "two").alias("cell"), (F.col("one") == F.col("two")).alias("within")), "cells")
    columns = ["tok", "cell", "within", "side", "component", "cls", "n", "pos", "before", *MARKS]
    sides = [placed.join(cells.withColumnRenamed(end, "at"), ["tok", "at"]).withColumn("side", F.lit(k)) for k, end in ((0, "one"), (1, "two"))]
    met = rows.where(F.col("k") <= BLOCK).withColumns({"cell": F.lit(0).cast("long"), "within": F.lit(True), "side": F.lit(0)}).select(columns)
    met = met.unionAll(sides[0].select(columns)).unionAll(sides[1].where("not within").select(columns))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            size += len(batch)
            if size < HELD_ROWS:
                continue
            t = pa.concat_tables(held).combine_chunks()
            starts = _starts(t, "tok", "cell")
            whole = int(starts[-1])  # the last cell may go on
            yield from _alike(t.slice(0, whole).combine_chunks(), percent, forest)
            held, size = [t.slice(whole).combine_chunks()], len(t) - whole
        if size:
            yield from _alike(pa.concat_tables(held).combine_chunks(), percent, forest)
        release()

    t = listed.schema["cls"].dataType.simpleString()
    found = met.repartition("tok", "cell").sortWithinPartitions("tok", "cell", "component").mapInArrow(pairs, f"a {t}, b {t}")
    found = materialise(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "remaining")
    discard(listed.sparkSession, listed, lists, rows, placed, cells)
    return found


def _starts(t: pa.Table, *columns: str) -> np.ndarray:
    """Where a new value of the columns begins in rows sorted by them."""
    new = np.zeros(len(t), bool)
    new[:1] = True
    for c in columns:
        codes = t.column(c).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def _alike(t: pa.Table, percent: int, forest: bool = False) -> Iterator[pa.RecordBatch]:
    """The pairs of each cell: every row with the rows after those of its own component, one step at a time for all rows.

    With ``forest``: of each cell's pairs only a spanning forest, of those whose signatures differ least for their sizes."""
    if not len(t):
        return
    size = len(t)
    cell_end, run_end = _ends(t, "tok", "cell"), _ends(t, "tok", "cell", "component")
    within, side, n, pos = (t.column(c).to_numpy().astype(np.int64) for c in ("within", "side", "n", "pos"))
    marked = np.asarray(t.column(MARKS[0]).is_valid())
    marks = np.stack([t.column(m).fill_null(0).to_numpy().view(np.uint64) for m in MARKS], axis=1)
    before = t.column("before").combine_chunks()
    lengths = before.value_lengths().fill_null(0).to_numpy()
    seen = np.zeros((size, BEFORE), np.int64)
    seen[np.arange(BEFORE) < lengths[:, None]] = before.flatten().to_numpy()
    cls = t.column("cls").combine_chunks()

    runs = np.cumsum(np.append(0, np.diff(run_end) != 0))

    def spanning(found: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        x, y, apart = (np.concatenate([f[k] for f in found]) for k in range(3))
        kept = spanning_forest(runs[x], runs[y], apart)
        return x[kept], y[kept], apart[kept]

    def batch(found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([cls.take(pa.array(np.concatenate([f[k] for f in found]))) for k in (0, 1)], ["a", "b"])

    found: list[tuple[np.ndarray, ...]] = []
    number, kept = 0, 0
    i = np.flatnonzero(run_end < cell_end)
    j = run_end[i]
    while len(i):
        for k in range(0, len(i), STEP_ROWS):
            x, y = i[k : k + STEP_ROWS], j[k : k + STEP_ROWS]
            both = n[x] + n[y]
            bound = np.minimum(n[x] - pos[x], n[y] - pos[y])
            may = ((within[x] == 1) | (side[x] != side[y])) & (bound * (100 + percent) >= both * percent)
            x, y, both = x[may], y[may], both[may]
            # Sets of these sizes differ in n1 + n2 - 2 overlaps, and in as many shingles as signatures differ in bits at least.
            differ = np.bitwise_count(marks[x] ^ marks[y]).sum(axis=1, dtype=np.int64)
            may = ~(marked[x] & marked[y]) | ((both - differ) * (100 + percent) >= 2 * percent * both)
            x, y, apart = x[may], y[may], (differ / both)[may]
            met = ((seen[x][:, :, None] == seen[y][:, None, :]) & (seen[x] != 0)[:, :, None]).any(axis=(1, 2))
            found.append((x[~met], y[~met], apart[~met]))
            number += len(found[-1][0])
        if forest and number > kept + HELD_PAIRS:
            found = [spanning(found)]
            number = kept = len(found[0][0])
        elif not forest and number > HELD_ROWS:
            yield batch(found)
            found, number = [], 0
        j = j + 1
        more = j < cell_end[i]
        i, j = i[more], j[more]
    if number:
        yield batch([spanning(found)] if forest else found)


def spanning_forest(u: np.ndarray, v: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The edges of a spanning forest of least weight, as places in the edges ``u - v``; all components in step (Borůvka)."""
    order = np.argsort(weight, kind="stable")
    nodes, at = np.unique(np.concatenate([u[order], v[order]]), return_inverse=True)
    u, v = at[: len(order)], at[len(order) :]
    rank = np.arange(len(order))  # of the edges left; no two alike, so choices close no circle
    label = np.arange(len(nodes))
    kept: list[np.ndarray] = []
    while len(rank := rank[label[u[rank]] != label[v[rank]]]):
        a, b = label[u[rank]], label[v[rank]]
        best = np.full(len(nodes), len(order))
        np.minimum.at(best, a, rank)
        np.minimum.at(best, b, rank)
        own = np.flatnonzero(best < len(order))
        best = best[own]
        kept.append(np.unique(best))
        other = label[u[best]] + label[v[best]] - own
        parent = np.arange(len(nodes))
        parent[own] = other
        back = own[(parent[other] == own) & (own < other)]  # two that chose the same edge: the smaller is the root
        parent[back] = back
        while (parent != (up := parent[parent])).any():
            parent = up
        label = parent[label]
    return order[np.concatenate([*kept, np.zeros(0, np.int64)])]


def _ends(t: pa.Table, *columns: str) -> np.ndarray:
    """For every row, where the rows with its values of the columns end."""
    starts = _starts(t, *columns)
    return np.repeat(np.append(starts[1:], len(t)), np.diff(starts, append=len(t)))


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """``id, set``: sorted 64-bit hashes. A repeated id stands for the union of its rows' sets only if they are equal."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 256):
                part = batch.slice(k, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in document_sets(part.column(1), words)], pa.binary())], ["id", "set"])

    return docs.select("id", "text").mapInArrow(build, f"id {docs.schema['id'].dataType.simpleString()}, set binary")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, with all their columns, without those whose component has a smaller id."""
    found = similar_components(docs, id_col, text_col, words, percent)
    drop = found.where(F.col("component_id") < F.col(id_col)).select(F.col(id_col).alias("_drop_id")).distinct()
    drop = materialise(drop, "dropped")  # of known size: the texts are shuffled only if it is large
    return docs.join(drop, F.col(id_col) == F.col("_drop_id"), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(table(spark, sf_dir, "documents"), words=3, percent=90)
