"""Jaccard self-join on word shingles with prefix filters under several token orders.

Plan, all steps exact:

1. Every row gets its set of distinct shingles as 64-bit hashes and a
   fingerprint of the set. Rows with one fingerprint are one *class*, so copies
   are never paired.
2. Shingles are counted in hash-range blocks (sorted differences, packed, an
   owner being a small number in its block), so that one shingle costs a few
   shuffled bytes, however many ranges there are. The counts go back to the
   blocks, whose classes are listed once. Two sets with Jaccard t share at
   least ``t * n`` shingles of either, hence a class with fewer shingles that
   more rows have than its own has no link and leaves.
3. Those that stay order their shingles globally in three ways: by counted
   frequency, ties by hash; by frequency, ties by another hash; by a hash
   alone. Linked sets share a token of their prefixes under *every* order; a
   pair is verified only if it passes all orders, the length bound and the
   place bound of the first. Frequencies come from a sketch of fixed size: any
   order is exact as long as it is the same for all sets.
4. Verification is in two rounds, so that a large group of near copies makes
   pairs in proportion to its size: first every class against the smallest
   class on each prefix token, then only pairs that lie in different components
   of the links found so far. A pair inside one component cannot change the
   components, so none is lost.

Defined results: a null or empty text has no shingles and is linked with
nothing; a text with fewer words than a shingle is one shingle; rows that
repeat, also with one id, are one class; a null id takes part, but never names
a component if another id can; ties cannot matter, as a component is named by
its smallest id; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from issuelens.llm.common import cut
from issuelens.llm.filters import filter_bits, may_have
from issuelens.llm.graph import components, fresh
from issuelens.llm.textbytes import LOWER, U64, Chunk, PrefixHash, mix, text_chunks, words

SHINGLE_WORDS = 5
PERCENT = 75
#: Hash ranges of the shingle count, shingles that a task gathers before it packs them, and the bits of their hashes.
RANGES = 64
GATHER = 2_000_000
COUNT_BITS = 40
BLOCKS = "part int, block long, wide int, tokens binary, owner binary, cls binary, n binary"
COUNTS = "block long, owner binary, df binary, cls binary, n binary"
#: Counters of the frequency sketch that orders the tokens, and the parts it is summed in.
SKETCH_BITS = 22
SKETCH_BLOCKS = 64
#: Bits of a set's parity signature.
SIGN_BITS = 512
#: Bits of the filter that keeps whole rows away from the second read of the texts.
FILTER_BITS = 22


def shingle_sets(chunk: Chunk, size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all rows, number of each row)."""
    chunk = Chunk(chunk.first, LOWER[chunk.buf], chunk.offsets)
    starts, ends = words(chunk)
    h = PrefixHash(chunk.buf).of(starts, ends)
    counts = np.diff(np.searchsorted(starts, chunk.offsets))
    # Windows of `size` words; a shorter row has one window, all its words.
    first = np.concatenate([[0], np.cumsum(counts)])
    windows = np.where(counts == 0, 0, np.maximum(counts - size + 1, 1))
    take = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows) + np.repeat(first[:-1], windows)
    end = np.repeat(first[1:], windows)
    key = np.full(len(take), 0x2545F491, np.uint64)
    for k in range(size):
        there = take + k < end
        word = h[np.minimum(take + k, len(h) - 1)] if len(h) else h
        key = np.where(there, mix(key * U64(31) + word), key)
    parts, sizes = [], np.zeros(chunk.n, np.int64)
    at = 0
    for row, n in enumerate(windows):
        if n:
            own = np.unique(key[at:at + n])
            parts.append(own)
            sizes[row] = len(own)
            at += n
    return (np.concatenate(parts) if parts else key[:0]), sizes


def fingerprints(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of each set, independent of order."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(tokens ^ U64(0xA5A5A5A5)))])
    end = np.cumsum(sizes)
    return mix(total[end] - total[end - sizes] + sizes.astype(np.uint64))


def class_rows(size: int):
    """Task body: ``(doc_id, row, cls, n)`` of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in text_chunks(batch.column("text")):
                tokens, sizes = shingle_sets(chunk, size)
                yield pa.record_batch({
                    "doc_id": batch.column("doc_id").slice(chunk.first, chunk.n),
                    "row": batch.column("row").slice(chunk.first, chunk.n),
                    "cls": pa.array(fingerprints(tokens, sizes).view(np.int64)),
                    "n": pa.array(sizes)})
    return run


def squeeze(values: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, compressed."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1)
    return zstandard.compress(np.ascontiguousarray(planes.T).tobytes(), 1)


def loosen(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def pack(values: np.ndarray) -> bytes:
    """Sorted numbers as differences."""
    return squeeze(np.diff(values, prepend=values.dtype.type(0)))


def unpack(data: bytes, kind: type = np.uint64) -> np.ndarray:
    return np.cumsum(loosen(data, kind), dtype=kind)


def block_name(task: int, number: int, names: np.ndarray) -> int:
    """Names the rows that a task gathered, by task, number and content."""
    key = np.array([task, number, zlib.crc32(names.tobytes())], np.uint64)
    return int(PrefixHash(key).of(np.array([0]), np.array([3])).view(np.int64)[0])


def shingle_blocks(size: int, ranges: int):
    """Task body: the shingles of the rows gathered at a time, by hash range, ``BLOCKS``.

    A shingle's owner is a number among the gathered rows, a few bits; the
    classes of all of them go once, in a row of their own, not with every range.

    Hashes are kept to ``COUNT_BITS`` here: two shingles that fall together only
    make the count larger, which keeps more classes, never fewer.
    """
    def flush(held: list, number: int) -> Iterator[pa.RecordBatch]:
        tokens = np.concatenate([t for t, _, _ in held])
        sizes = np.concatenate([s for _, s, _ in held])
        names = np.concatenate([c for _, _, c in held])
        task = TaskContext.get()
        block = block_name(task.partitionId() if task else 0, number, names)
        once = np.zeros(len(names), bool)  # copies in one block count once
        once[np.unique(names, return_index=True)[1]] = True
        owner = np.repeat(np.arange(len(names), dtype=np.uint16 if len(names) < 1 << 16 else np.uint32), sizes)
        keep = once[owner]
        tokens, owner = tokens[keep] >> U64(64 - COUNT_BITS), owner[keep]
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], owner[order]
        bounds = np.searchsorted(tokens, (np.arange(ranges + 1, dtype=np.uint64) << U64(COUNT_BITS)) // U64(ranges))
        parts = np.flatnonzero(np.diff(bounds))
        spans = [slice(bounds[part], bounds[part + 1]) for part in parts]
        yield block_rows(
            part=[block % ranges, *parts.tolist()], block=[block] * (len(parts) + 1), wide=[owner.itemsize] * (len(parts) + 1),
            tokens=[None, *(pack(tokens[s]) for s in spans)], owner=[None, *(squeeze(owner[s]) for s in spans)],
            cls=[names.tobytes(), *[None] * len(parts)], n=[sizes.tobytes(), *[None] * len(parts)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, number = [], 0, 0
        for batch in batches:
            for chunk in text_chunks(batch.column("text")):
                tokens, sizes = shingle_sets(chunk, size)
                if len(tokens):
                    held.append((tokens, sizes, fingerprints(tokens, sizes)))
                    count += len(tokens)
                if count >= GATHER:
                    yield from flush(held, number)
                    held, count, number = [], 0, number + 1
        if held:
            yield from flush(held, number)
    return run


def block_rows(part: list | None = None, **columns: list) -> pa.RecordBatch:
    kinds = {"block": pa.int64(), "wide": pa.int32()}
    arrays = {k: pa.array(v, kinds.get(k, pa.binary())) for k, v in columns.items()}
    return pa.record_batch(({"part": pa.array(part, pa.int32())} if part else {}) | arrays)


def shared_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task body over blocks: how many rows have each shingle, for those that two have or more, ``COUNTS``.

    The blocks of one partition hold whole hash ranges, so a task has a bounded
    share of all shingles (the number of ranges grows with the shuffle). Rows
    with the classes of a block pass through.
    """
    tokens, owner, blocks = [], [], []
    for batch in batches:
        for block, wide, t, o, c, n in zip(*(batch.column(k).to_pylist() for k in ("block", "wide", "tokens", "owner", "cls", "n"))):
            if c is not None:
                yield block_rows(block=[block], owner=[None], df=[None], cls=[c], n=[n])
            else:
                tokens.append(unpack(t))
                owner.append(loosen(o, np.uint16 if wide == 2 else np.uint32))
                blocks.append(block)
    if not tokens:
        return
    ends = np.cumsum([len(t) for t in tokens])
    tokens = np.concatenate(tokens)
    order = np.argsort(tokens, kind="stable")
    tokens = tokens[order]
    first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
    counts = np.diff(first, append=len(tokens)).astype(np.uint32)
    df = np.empty(len(tokens), np.uint32)
    df[order] = np.repeat(counts, counts)
    held = []
    for block, end, who in zip(blocks, ends.tolist(), owner):
        own = df[end - len(who):end]
        at = np.flatnonzero(own > 1)
        if len(at):
            at = at[np.argsort(who[at], kind="stable")]
            held.append((block, pack(who[at].astype(np.uint32)), squeeze(own[at])))
    for a in range(0, len(held), 1000):
        name, who, own = zip(*held[a:a + 1000])
        yield block_rows(block=name, owner=who, df=own, cls=[None] * len(name), n=[None] * len(name))


def reaches(percent: int):
    """Task body over ``COUNTS``, whole blocks sorted by name: ``(cls, reach)`` of each class of a block.

    A class needs ``percent`` of its ``n`` shingles in another one. As many of
    them are in ``reach`` rows or more, the class's own rows included (one for
    each block that has it). Classes that reach no second row are left out.
    """
    def reach(classes: tuple[bytes, bytes] | None, owner: list, df: list) -> Iterator[pa.RecordBatch]:
        if classes is None:
            raise RuntimeError("a task that was run again read its rows in another order: checkpoint the documents first")
        if not owner:
            return
        cls, n = np.frombuffer(classes[0], np.int64), np.frombuffer(classes[1], np.int64)
        owner, df = np.concatenate(owner), np.concatenate(df)
        need = np.maximum(-(-n * percent // 100), 1)
        have = np.bincount(owner, minlength=len(n))
        enough = have >= need
        owner, df = owner[enough[owner]], df[enough[owner]]
        df = df[np.lexsort((df, owner))]
        at = np.cumsum(have[enough]) - need[enough]  # the largest last
        yield pa.record_batch({"cls": pa.array(cls[enough]), "reach": pa.array(df[at].astype(np.int64))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, classes, owner, df = None, None, [], []
        for batch in batches:
            for block, o, d, c, n in zip(*(batch.column(k).to_pylist() for k in ("block", "owner", "df", "cls", "n"))):
                if block != last:
                    if last is not None:
                        yield from reach(classes, owner, df)
                    last, classes, owner, df = block, None, [], []
                if c is not None:
                    classes = c, n
                else:
                    owner.append(unpack(o, np.uint32))
                    df.append(loosen(d, np.uint32))
        if last is not None:
            yield from reach(classes, owner, df)
    return run


def wanted_sets(size: int, bitmap: np.ndarray):
    """Task body: ``(cls, n, tokens)`` of the rows whose key may be wanted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in text_chunks(batch.column("text")):
                tokens, sizes = shingle_sets(chunk, size)
                names = fingerprints(tokens, sizes)
                use = np.flatnonzero((sizes > 0) & may_have(bitmap, names))
                end = np.cumsum(sizes)
                seen, rows = np.unique(names[use], return_index=True)
                use = np.sort(use[rows])
                yield pa.record_batch({
                    "cls": pa.array(names[use].view(np.int64)), "n": pa.array(sizes[use]),
                    "tokens": pa.array([tokens[end[r] - sizes[r]:end[r]].view(np.int64) for r in use],
                                       pa.list_(pa.int64()))})
    return run


def sketch_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task body over ``tokens``: the task's counters of all tokens, in compressed blocks ``(block, counters)``."""
    total = np.zeros(1 << SKETCH_BITS, np.uint32)
    for batch in batches:
        tokens = batch.column("tokens").values.to_numpy().view(np.uint64)
        if len(tokens):
            total += np.bincount(cell(tokens), minlength=len(total)).astype(np.uint32)
    for i, part in enumerate(np.split(total, SKETCH_BLOCKS)):
        if part.any():
            yield pa.record_batch({"block": pa.array([i], pa.int32()),
                                   "counters": pa.array([zstandard.compress(part.tobytes(), 1)], pa.binary())})


def sketch_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task body over blocks: the sum of each block of the partition."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, data in zip(batch.column("block").to_pylist(), batch.column("counters").to_pylist()):
            part = np.frombuffer(zstandard.decompress(data), np.uint32)
            total[i] = total[i] + part if i in total else part
    for i, part in total.items():
        yield pa.record_batch({"block": pa.array([i], pa.int32()),
                               "counters": pa.array([zstandard.compress(part.tobytes(), 1)], pa.binary())})


def cell(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> U64(64 - SKETCH_BITS)).astype(np.int64)


def token_sketch(sets: DataFrame) -> np.ndarray:
    """How many of the ``sets`` have a token, at least: ``2**SKETCH_BITS`` counters, whatever the number of sets."""
    form = "block int, counters binary"
    rows = (sets.select("tokens").mapInArrow(sketch_blocks, form).repartition("block").mapInArrow(sketch_sums, form)
            .toArrow())
    total = np.zeros((SKETCH_BLOCKS, (1 << SKETCH_BITS) // SKETCH_BLOCKS), np.uint32)
    for i, data in zip(rows.column("block").to_pylist(), rows.column("counters").to_pylist()):
        total[i] += np.frombuffer(zstandard.decompress(data), np.uint32)
    return total.ravel()


def prefixes(sketch: np.ndarray, percent: int):
    """Task body: ``(cls, n, tok, at, other, lone, signs)`` of the sets.

    ``tok`` and ``at`` are the prefix under the first order and the places in
    it, ``other`` the prefix under the second. Both orders are global, as they
    go by the token's counter and hash alone. A token whose counter is 1 is in
    no other set: it has its place, but is left out. ``lone`` counts those
    tokens, and ``signs`` has a bit for the parity of the others in each of
    ``SIGN_BITS`` classes: two sets differ in at least their lone tokens and as
    many others as their signs differ in.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for n, tokens in zip(batch.column("n").to_pylist(), batch.column("tokens")):
                tokens = tokens.values.to_numpy().view(np.uint64)
                df = sketch[cell(tokens)]
                length = n - -(-n * percent // 100) + 1
                first, second = np.lexsort((tokens, df))[:length], np.lexsort((mix(tokens), df))[:length]
                at = np.flatnonzero(df[first] > 1)
                odd = np.bincount((mix(tokens[df > 1]) & U64(SIGN_BITS - 1)).astype(np.int64), minlength=SIGN_BITS) & 1
                rows.append((tokens[first[at]].view(np.int64), at.astype(np.int32),
                             tokens[second[df[second] > 1]].view(np.int64), int((df == 1).sum()),
                             np.packbits(odd.astype(bool)).view(np.int64)))
            tok, at, other, lone, signs = zip(*rows) if rows else ((),) * 5
            yield pa.record_batch({
                "cls": batch.column("cls"), "n": batch.column("n"), "tok": pa.array(tok, pa.list_(pa.int64())),
                "at": pa.array(at, pa.list_(pa.int32())), "other": pa.array(other, pa.list_(pa.int64())),
                "lone": pa.array(lone, pa.int64()), "signs": pa.array(signs, pa.list_(pa.int64()))})
    return run


def verified(pairs: DataFrame, heads: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that share a prefix token under the second and the third order too, and reach the similarity."""
    def side(table: DataFrame, name: str, *columns: str) -> DataFrame:
        return table.select(F.col("cls").alias(name), *(F.col(c).alias(f"{c}_{name}") for c in columns))

    def by_hash(name: str) -> Column:
        """The prefix under the order by a seeded hash alone."""
        n = F.col(f"n_{name}")
        order = F.transform(f"tokens_{name}", lambda t: F.struct(F.xxhash64(t, F.lit(3)).alias("h"), t.alias("t")))
        return F.slice(F.sort_array(order), F.lit(1), (n - F.ceil(n * percent / 100) + 1).cast("int"))["t"]

    second = (pairs.join(side(heads, "a", "other"), "a").join(side(heads, "b", "other"), "b")
              .where(F.arrays_overlap("other_a", "other_b")).select("a", "b"))
    both = F.size(F.array_intersect("tokens_a", "tokens_b"))
    return (second.join(side(sets, "a", "n", "tokens"), "a").join(side(sets, "b", "n", "tokens"), "b")
            .where(F.arrays_overlap(by_hash("a"), by_hash("b")))
            .where(100 * both >= percent * (F.col("n_a") + F.col("n_b") - both)).select("a", "b"))


def may_link(percent: int, na: str, ia: str, nb: str, ib: str) -> Column:
    """Length bound, and place bound of a pair's first common token.

    No token before the first common one is in the other set, so the places of
    that token are together at most the difference that the similarity allows.
    """
    a, b = F.col(na), F.col(nb)
    length = (100 * a >= percent * b) & (100 * b >= percent * a)
    return length & ((F.col(ia) + F.col(ib)) * (100 + percent) <= (a + b) * (100 - percent))


def class_links(sets: DataFrame, percent: int) -> DataFrame:
    """``(node, root)``: the components of the classes that have a link."""
    form = "cls long, n long, tok array<long>, at array<int>, other array<long>, lone long, signs array<long>"
    heads = cut(sets.mapInArrow(prefixes(token_sketch(sets), percent), form))
    postings = (heads.select("cls", "n", F.explode(F.arrays_zip("tok", "at")).alias("p"))
                .select("cls", "n", "p.tok", "p.at"))
    pivot = postings.groupBy("tok").agg(F.min(F.struct("at", "n", "cls")).alias("p"), F.count("*").alias("df")).where("df > 1")
    stars = (fresh(postings, "tok").join(fresh(pivot, "tok").drop("tok"), "tok_k")
             .withColumns({"pn": F.col("p.n"), "pat": F.col("p.at")})
             .where((F.col("cls") != F.col("p.cls")) & may_link(percent, "n", "at", "pn", "pat"))
             .select(F.least("cls", "p.cls").alias("a"), F.greatest("cls", "p.cls").alias("b")).distinct())
    first = cut(components(verified(stars, heads, sets, percent)))
    # What is left: pairs on one token whose ends are in different components. The largest component of a
    # token meets the others, never itself.
    placed = cut(postings.join(first.withColumnRenamed("node", "cls"), "cls", "left")
                 .select("tok", "cls", "n", "at", F.coalesce("root", "cls").alias("comp")))
    split = (placed.groupBy("tok", "comp").agg(F.count("*").alias("k"))
             .groupBy("tok").agg(F.max(F.struct("k", "comp"))["comp"].alias("big"), F.count("*").alias("comps"))
             .where("comps > 1"))
    marks = [F.col("signs")[k].alias(f"s{k}") for k in range(SIGN_BITS // 64)]
    placed = cut(fresh(placed, "tok").join(fresh(split, "tok").drop("tok"), "tok_k").drop("tok_k")
                 .join(heads.select("cls", "lone", *marks), "cls"))
    cols = [c for c in placed.columns if c not in ("tok", "big")]
    one = placed.where("comp <> big").select("tok", *(F.col(c).alias(f"{c}_a") for c in cols))
    two = placed.select("tok", "big", *(F.col(c).alias(f"{c}_b") for c in cols))
    differ = F.col("lone_a") + F.col("lone_b")
    for k in range(SIGN_BITS // 64):
        differ = differ + F.bit_count(F.col(f"s{k}_a").bitwiseXOR(F.col(f"s{k}_b")))
    pairs = (one.join(two, "tok").where("comp_a <> comp_b and (comp_b = big or cls_a < cls_b)")
             .where(may_link(percent, "n_a", "at_a", "n_b", "at_b"))
             .where(differ * (100 + percent) <= (F.col("n_a") + F.col("n_b")) * (100 - percent))
             .select(F.col("cls_a").alias("a"), F.col("cls_b").alias("b")).distinct())
    second = verified(pairs, heads, sets, percent)
    tree = first.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    return components(second.unionByName(tree))


def near_groups(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE_WORDS) -> DataFrame:
    """``(doc_id, row, n, root, component_id)`` for every row of ``docs (doc_id, row, text)``, a ``row`` being any long.

    Rows of one component have one ``root``; rows without words have none.
    """
    spark = docs.sparkSession
    rows = cut(docs.mapInArrow(class_rows(size), "doc_id long, row long, cls long, n long"))
    ranges = max(RANGES, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    blocks = docs.select("text").mapInArrow(shingle_blocks(size, ranges), BLOCKS)
    counts = blocks.repartition(ranges, "part").mapInArrow(shared_counts, COUNTS)
    found = (counts.repartition("block").sortWithinPartitions("block").mapInArrow(reaches(percent), "cls long, reach long")
             .groupBy("cls").agg(F.max("reach").alias("reach"), F.count("*").alias("own")))
    wanted = cut(found.where("reach > own").select("cls"))
    bitmap = filter_bits(wanted, F.col("cls"), FILTER_BITS)
    sets = (docs.select("text").mapInArrow(wanted_sets(size, bitmap), "cls long, n long, tokens array<long>")
            .join(wanted, "cls", "left_semi").dropDuplicates(["cls"]))
    links = class_links(cut(sets), percent)
    names = rows.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("least"))
    named = names.join(links.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_class = named.select("cls", "root").join(least, "root").select("cls", "root", "component_id")
    return (fresh(rows, "cls").join(fresh(by_class, "cls").drop("cls"), "cls_k", "left")
            .select("doc_id", "row", "n", F.when(F.col("n") > 0, F.col("root")).alias("root"),
                    F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")))


def ngram_join(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE_WORDS) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for every row of ``docs (doc_id, text)``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).cast("long").alias("row"), "text")
    return near_groups(rows, percent, size).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
