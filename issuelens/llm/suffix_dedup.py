"""Removal of long repeated substrings by a depth-limited radix sort of suffixes.

Suffixes are compared through ``length`` units only, most significant digit
first; a suffix that is alone in its group leaves, and the groups that are left
after the last digit are exactly the repeated windows. Units are the UTF-8
bytes of a text, or its words ``[^\\x20\\x09-\\x0D]+`` (white space between them
does not count, and a span reaches from its first word to its last).

* Digit 1 is a gram of ``length // 2`` units. It is taken at *anchors* alone:
  in every window of ``length`` bytes the leftmost smallest gram hash (by
  content, so equal windows have the same anchor at the same place). Grams are
  counted over all texts; an anchor whose gram is nowhere else leaves here.
* Digit 2 is the whole context that the windows of an anchor can reach. If it
  occurs twice, all those windows do, and the anchor is settled.
* For the anchors left, each with one row per different context, the windows
  are sorted by digits of ``DIGITS`` units. In a group of more than ``BLOCK``
  contexts one more digit comes first, the units that ``PARTS`` ranges of the
  windows have in common; then it is sorted in salted blocks, and windows that
  are alone in their block are counted across blocks.

Digits are 64-bit hashes of the units. Rows are named by xxhash64 of id and
text, so rows that repeat share a name and count as copies of each other.

Defined results: a null text is empty; an empty or short text loses nothing;
texts that are equal (also with equal ids) lose everything that is ``length``
units or longer; an empty table gives an empty result; other columns pass
through untouched, except that ``dedup`` is added (a column of that name is
replaced). A text is handled whole, in memory of its own size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from issuelens.llm.common import cut, free
from issuelens.llm.filters import filter_bits, may_have
from issuelens.llm.graph import fresh
from issuelens.llm.textbytes import POWERS, U64, Chunk, PrefixHash, mix, repeated, text_chunks, word_chunk, words

LENGTH = 400
DIGITS = (8, 32)
BLOCK = 4000
PARTS = 8
FILTER_BITS = 23
ANCHOR = "row long, pos long, before int, after int, gram long, ctx long"
HIGH = U64(0xFFFFFFFF00000000)


def unit_chunks(column: pa.Array, unit: str) -> Iterator[Chunk]:
    """Whole rows as chunks of their ``byte`` or ``word`` units."""
    for chunk in text_chunks(column):
        yield chunk if unit == "byte" else word_chunk(chunk)


class Anchors:
    """The anchors of a chunk: position, row, gram hash, context bounds and context hash."""

    def __init__(self, chunk: Chunk, length: int) -> None:
        gram, n = max(1, length // 2), len(chunk.buf)
        width = length - gram + 1
        self.hashes = PrefixHash(chunk.buf)
        self.pos = np.zeros(0, np.int64)
        if n >= length:
            sums = self.hashes.sums
            key = (sums[gram:] - sums[:-gram]) * POWERS.down[:n - gram + 1]
            key &= HIGH
            key |= np.arange(len(key), dtype=np.uint64)
            least = sliding_min(key, width)  # one for each window of `length` bytes
            there = np.ones(len(least), bool)
            for end in chunk.offsets[1:-1]:  # windows that cross the end of a text
                there[max(0, end - length + 1):end] = False
            places = (least[there] & ~HIGH).astype(np.int64)
            self.pos = places[np.concatenate([[True], places[1:] != places[:-1]])] if len(places) else places
        self.row = chunk.row_of(self.pos)
        self.start = np.maximum(self.pos - (width - 1), chunk.offsets[self.row])
        self.end = np.minimum(self.pos + length, chunk.offsets[self.row + 1])
        self.gram = self.hashes.of(self.pos, self.pos + gram)
        left = self.hashes.of(self.start, self.pos)
        self.ctx = mix(left * U64(3) + self.hashes.of(self.pos, self.end))


def sliding_min(key: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours: smallest of a block's tail and the next block's head."""
    n = len(key)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = key
    blocks = padded.reshape(-1, width)
    head = np.minimum.accumulate(blocks, axis=1).ravel()
    tail = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[:n - width + 1], head[width - 1:n])


def gram_counts(length: int, unit: str):
    """Task body: ``(gram, count)`` of the anchors of each chunk."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in unit_chunks(batch.column("text"), unit):
                grams, counts = np.unique(Anchors(chunk, length).gram, return_counts=True)
                yield pa.record_batch({"gram": pa.array(grams.view(np.int64)), "count": pa.array(counts)})
    return run


def anchor_rows(length: int, bitmap: np.ndarray, unit: str):
    """Task body: the anchors whose gram may be repeated."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("row").to_numpy()
            for chunk in unit_chunks(batch.column("text"), unit):
                a = Anchors(chunk, length)
                use = may_have(bitmap, a.gram)
                row, pos = a.row[use], a.pos[use]
                yield pa.record_batch({
                    "row": pa.array(names[row + chunk.first]), "pos": pa.array(pos - chunk.offsets[row]),
                    "before": pa.array((pos - a.start[use]).astype(np.int32)),
                    "after": pa.array((a.end[use] - pos).astype(np.int32)),
                    "gram": pa.array(a.gram[use].view(np.int64)), "ctx": pa.array(a.ctx[use].view(np.int64))})
    return run


def context_bytes(length: int, bitmap: np.ndarray, unit: str):
    """Task body: ``(ctx, bytes)`` of the contexts that may be wanted, once for each chunk."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in unit_chunks(batch.column("text"), unit):
                a = Anchors(chunk, length)
                use = np.flatnonzero(may_have(bitmap, a.ctx))
                use = use[np.unique(a.ctx[use], return_index=True)[1]]
                for part in np.array_split(use, len(use) // 20_000 + 1):
                    yield pa.record_batch({
                        "ctx": pa.array(a.ctx[part].view(np.int64)),
                        "bytes": pa.array([chunk.buf[a.start[i]:a.end[i]].tobytes() for i in part], pa.binary())})
    return run


def range_keys(length: int, bitmap: np.ndarray, unit: str):
    """Task body: ``(ctx, part, key)`` of the contexts that may be in a large group.

    The windows of an anchor are split into ``PARTS`` ranges by the anchor's
    place in them; the key is the bytes that all windows of a range have.
    """
    gram = max(1, length // 2)
    width = length - gram + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in unit_chunks(batch.column("text"), unit):
                a = Anchors(chunk, length)
                use = np.flatnonzero(may_have(bitmap, a.ctx))
                use = use[np.unique(a.ctx[use], return_index=True)[1]]
                for part in range(PARTS):
                    least, most = part * width // PARTS, (part + 1) * width // PARTS - 1  # bytes before the anchor
                    ok = use[(a.start[use] <= a.pos[use] - least) & (a.end[use] >= a.pos[use] + length - most)]
                    key = a.hashes.of(a.pos[ok] - least, a.pos[ok] + length - most)
                    yield pa.record_batch({
                        "ctx": pa.array(a.ctx[ok].view(np.int64)), "part": pa.array(np.full(len(ok), part, np.int32)),
                        "key": pa.array(mix(key + U64(part)).view(np.int64))})
    return run


def sort_windows(length: int, unit: str):
    """Task body over ``(gram, salt, salts, live, row, pos, before, own, bytes)``, whole (gram, salt) blocks in a partition.

    Gives ``(row, start, end)`` for the windows repeated in a block, and
    ``(row, start, end, key)`` for those of salted groups that must be counted
    across blocks; ``own`` is false where a row is evidence only.
    """
    gram = max(1, length // 2)
    width = length - gram + 1
    out = T.StructType.fromDDL("row long, start long, end long, key long, own boolean")
    bounds = [0, *(d for d in np.cumsum(DIGITS) if d < length), length]
    part_of = np.zeros(width, np.int64)
    for part in range(PARTS):
        part_of[part * width // PARTS:(part + 1) * width // PARTS] = part

    def block(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
        col = {k: t.column(k).to_numpy(zero_copy_only=False) for k in ("gram", "salt", "salts", "live", "row", "pos", "before", "own")}
        data = t.column("bytes")
        kind = np.dtype(np.uint8 if unit == "byte" else np.uint64)
        offs = np.frombuffer(data.buffers()[1], np.int32)[data.offset:data.offset + len(data) + 1].astype(np.int64)
        buf = np.frombuffer(data.buffers()[2], np.uint8)[offs[0]:offs[-1]].copy().view(kind)
        offs = (offs - offs[0]) // kind.itemsize
        hashes = PrefixHash(buf)
        windows = np.minimum(offs[1:] - offs[:-1] - length + 1, width)
        group = mix(col["gram"].view(np.uint64) + col["salt"].astype(np.uint64) * U64(0x9E3779B1))
        who = np.repeat(np.arange(len(windows)), windows)
        shift = np.arange(len(who)) - np.repeat(np.cumsum(windows) - windows, windows)
        align = col["before"][who] - shift  # the anchor's place in the window
        ok = (align >= 0) & (align + gram <= length)
        ok &= (col["live"][who] >> part_of[np.clip(align, 0, width - 1)]) & 1 == 1
        who, shift, align = who[ok], shift[ok], align[ok]
        begin = offs[who] + shift
        key = mix(group[who] + align.astype(np.uint64) * U64(0xD1B54A33))
        salted = col["salts"][who] > 1
        live = np.ones(len(who), bool)
        for a, b in zip(bounds, bounds[1:]):
            at = np.flatnonzero(live)
            key[at] = mix(key[at] * U64(31) + hashes.of(begin[at] + a, begin[at] + b))
            twice, _ = repeated(key[at])
            live[at[~twice & ~salted[at]]] = False
            alone = at[~twice]
        solo = np.zeros(len(who), bool)
        solo[alone] = salted[alone]
        live &= ~solo
        own = col["own"][who]
        start = col["pos"][who] - align
        got = np.flatnonzero(live & own)
        if len(got):  # all windows of a member hold its anchor, so they make one run
            first = np.flatnonzero(np.concatenate([[True], who[got][1:] != who[got][:-1]]))
            last = np.append(first[1:], len(got)) - 1
            yield pa.record_batch({
                "row": pa.array(col["row"][who[got[first]]]), "start": pa.array(start[got[first]]),
                "end": pa.array(start[got[last]] + length), "key": pa.nulls(len(first), pa.int64()),
                "own": pa.array(np.ones(len(first), bool))})
        # Salted groups: every window alone in its block, and one of each that is not, under a key without the salt.
        if salted.any():
            seen = np.flatnonzero(live & salted)
            seen = seen[np.unique(key[seen], return_index=True)[1]]
            rest = np.concatenate([np.flatnonzero(solo), seen])
            whole = mix(mix(col["gram"].view(np.uint64)[who[rest]] + align[rest].astype(np.uint64) * U64(0xD1B54A33))
                        + hashes.of(begin[rest], begin[rest] + length))
            mine = own[rest] & solo[rest]
            for k in range(0, len(rest), 100_000):
                s = slice(k, k + 100_000)
                yield pa.record_batch({
                    "row": pa.array(col["row"][who[rest[s]]]), "start": pa.array(start[rest[s]]),
                    "end": pa.array(start[rest[s]] + length), "key": pa.array(whole[s].view(np.int64)),
                    "own": pa.array(mine[s])})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, last = [], 0, None
        for batch in batches:  # sorted by gram and salt
            keys = list(zip(batch.column("gram").to_pylist(), batch.column("salt").to_pylist()))
            at = 0
            while at < len(keys):
                to = at + 1
                while to < len(keys) and keys[to] == keys[at]:
                    to += 1
                if count >= 10_000 and keys[at] != last:
                    yield from block(held)
                    held, count = [], 0
                held.append(batch.slice(at, to - at))
                count, last, at = count + to - at, keys[to - 1], to
        if held:
            yield from block(held)

    return run, out


def in_reach(docs: DataFrame, members: DataFrame, length: int, unit: str) -> DataFrame:
    """``members`` with ``live``, a bit for each range of windows that may be repeated, without those that have none.

    In a group of more than ``BLOCK`` contexts, the bytes common to the windows
    of a range are the next digit: a context that is alone with them has no
    repeated window there. Counts alone are gathered, whatever the group's size.
    """
    large = members.where("salts > 1")
    every = F.lit((1 << PARTS) - 1)
    if large.isEmpty():
        return members.withColumn("live", every)
    keys = docs.select("text").mapInArrow(range_keys(length, filter_bits(large, F.col("ctx"), FILTER_BITS), unit),
                                          "ctx long, part int, key long")
    keys = cut(keys)
    shared = keys.groupBy("key").agg(F.min("ctx").alias("a"), F.max("ctx").alias("b")).where("a <> b").select("key")
    live = (fresh(keys, "key").join(fresh(shared, "key").drop("key"), "key_k", "left_semi")
            .groupBy("ctx").agg(F.expr("bit_or(shiftleft(1, part))").alias("live")))
    kept = large.join(live, "ctx").unionByName(members.where("salts = 1").withColumn("live", every))
    return cut(kept)


def repeated_spans(docs: DataFrame, length: int = LENGTH, unit: str = "byte") -> DataFrame:
    """``(row, start, end)``: spans of units that hold all repeated windows of the rows ``(row, text)``."""
    counts = (docs.select("text").mapInArrow(gram_counts(length, unit), "gram long, count long")
              .groupBy("gram").agg(F.sum("count").alias("n")).where("n > 1"))
    grams = cut(counts.select("gram"))
    bitmap = filter_bits(grams, F.col("gram"), FILTER_BITS)
    found = docs.mapInArrow(anchor_rows(length, bitmap, unit), ANCHOR)
    found = cut(fresh(found, "gram").join(fresh(grams, "gram").drop("gram"), "gram_k", "left_semi").drop("gram_k"))
    # One row for each different context of a gram; contexts found twice are settled.
    kinds = cut(found.groupBy("gram", "ctx").agg(F.count("*").alias("copies"),
                                                 F.min(F.struct("row", "pos", "before")).alias("at")))
    settled = kinds.where("copies > 1").select("ctx")
    whole = (fresh(found, "ctx").join(fresh(settled, "ctx").drop("ctx"), "ctx_k", "left_semi")
             .select("row", (F.col("pos") - F.col("before")).alias("start"), (F.col("pos") + F.col("after")).alias("end")))
    many = kinds.groupBy("gram").agg(F.count("*").alias("kinds")).where("kinds > 1")
    members = cut(fresh(kinds, "gram").join(fresh(many, "gram").drop("gram"), "gram_k")
                  .withColumn("salts", F.ceil(F.col("kinds") / BLOCK).cast("int"))
                  .select("gram", "ctx", "salts", F.pmod(F.xxhash64("ctx"), F.col("salts")).cast("int").alias("salt"),
                          "at.row", "at.pos", "at.before", (F.col("copies") == 1).alias("own")))
    members = in_reach(docs, members, length, unit)
    wanted = filter_bits(members, F.col("ctx"), FILTER_BITS)
    contexts = (docs.select("text").mapInArrow(context_bytes(length, wanted, unit), "ctx long, bytes binary")
                .dropDuplicates(["ctx"]))
    body, schema = sort_windows(length, unit)
    blocks = (members.join(contexts, "ctx").repartition("gram", "salt").sortWithinPartitions("gram", "salt")
              .mapInArrow(body, schema))
    blocks = cut(blocks)
    across = blocks.where("key is not null")
    twice = across.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    late = fresh(across.where("own"), "key").join(fresh(twice, "key").drop("key"), "key_k", "left_semi")
    return (whole.unionByName(blocks.where("key is null").select("row", "start", "end"))
            .unionByName(late.select("row", "start", "end")))


def suffix_dedup(docs: DataFrame, length: int = LENGTH, unit: str = "byte") -> DataFrame:
    """The rows of ``docs`` with the struct ``dedup``: n_bytes, n_removed, spans (removed runs of bytes), kept (bytes), kept_text.

    ``kept_text`` leaves out bytes of characters that a span cut in two, and is
    null for a null text.
    """
    names = [c for c in docs.columns if c.lower() != "dedup"]
    key, found = free("dedup_row", docs.columns), free("dedup_spans", docs.columns)
    keyed = docs.select(F.xxhash64(F.col("doc_id"), F.col("text")).alias("row"), "text")
    spans = (repeated_spans(keyed, length, unit).groupBy("row", "start").agg(F.max("end").alias("end"))
             .groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias(found)))
    out = T.StructType([*(docs.schema[c] for c in names), T.StructField("dedup", T.StructType.fromDDL(
        "n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary, kept_text string"))])
    joined = (docs.select(*names, F.xxhash64(F.col("doc_id"), F.col("text")).alias(key))
              .join(spans.withColumnRenamed("row", key), key, "left").drop(key))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                rows = []
                for text, list_ in zip(part.column("text").to_pylist(), part.column(found).to_pylist()):
                    data = (text or "").encode()
                    merged: list[list[int]] = []
                    if list_ and unit == "word":
                        starts, ends = words(Chunk(0, np.frombuffer(data, np.uint8), np.array([0, len(data)])))
                        list_ = [{"start": int(starts[s["start"]]), "end": int(ends[s["end"] - 1])} for s in list_]
                    for s in list_ or ():
                        if merged and s["start"] <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], s["end"])
                        else:
                            merged.append([s["start"], s["end"]])
                    at, kept = 0, []
                    for s, e in merged:
                        kept.append(data[at:s])
                        at = e
                    kept.append(data[at:])
                    rest = b"".join(kept)
                    rows.append({"n_bytes": len(data), "n_removed": sum(e - s for s, e in merged),
                                 "spans": [{"start": s, "end": e} for s, e in merged], "kept": rest,
                                 "kept_text": None if text is None else rest.decode("utf-8", "ignore")})
                kind = pa.struct([("n_bytes", pa.int64()), ("n_removed", pa.int64()),
                                  ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                                  ("kept", pa.binary()), ("kept_text", pa.string())])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(rows, kind)],
                                                 names=[*names, "dedup"])

    return joined.mapInArrow(run, out)
