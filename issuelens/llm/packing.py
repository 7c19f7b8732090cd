"""Best-fit packing of tokenised documents by a configuration linear program.

1. Texts become token ids; a document longer than ``capacity`` is cut.
2. The lengths are counted over all pieces. The histogram has at most
   ``capacity`` entries, whatever the number of documents, and is all that the
   driver sees.
3. The number of sequences of each *configuration* (how many pieces of each
   length share a sequence) is found by multiplicative weights: a weight for
   each length, knapsack dynamic programming prices the best filling of a
   sequence that starts with each length, lengths covered too little gain
   weight. Rounding goes on with these weights: in each round every length
   places half of what it has left in configurations of whole pieces. The last
   pieces, a twentieth and never more than ``REST``, are packed best-fit
   decreasing. The plan holds the configurations of each round, so its size
   goes with the lengths and the logarithm of the pieces.
4. A piece finds its sequence by its rank among the pieces of its length; ranks
   come from per-partition counts, so no length is ever collected in one task.

Defined results: a null or empty text is the end token alone; repeated rows are
packed each for itself; an empty table gives an empty result; columns other
than doc_id and text are not read. A text of any length is cut into pieces.
"""

from __future__ import annotations

import bisect
import os
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from issuelens.llm.common import cut
from issuelens.llm.textbytes import LOWER, SPACE, Chunk, PrefixHash, text_chunks

CAPACITY = 4096
END_ID = 1
#: Groups of lengths that the program gives weights to, and how fast the weights fall.
GROUPS = 64
RATE = 2.0
#: Steps that share a pricing.
PRICED_STEPS = 4
#: Pieces that best fit packs at most.
REST = 20_000
CACHED_WORDS = 600_000

#: 1: ASCII letter, 2: sign that never belongs to a token with a letter, 0: anything else.
KIND = np.zeros(256, np.int8)
KIND[ord("a"):ord("z") + 1] = KIND[ord("A"):ord("Z") + 1] = 1
SIGNS = "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"
KIND[[ord(c) for c in SIGNS]] = 2

#: Runs that are one word of the vocabulary's pre-tokenizer and in its normal form but for case: Latin letters, none
#: that takes a combining mark when it is lower-cased (U+0130). Its model is given their bytes as these characters.
LETTERS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+")
PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_CHARS = {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(PRINTED)))}

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_runs(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends) of the runs that the tokenizer treats one by one.

    The vocabulary's pre-tokenizer never joins across white space, nor an ASCII
    letter with an ASCII sign of ``SIGNS``; it lower-cases, and without
    combining marks or special tokens that can be done before. Hence the ids of
    a text are those of its runs, one after the other.
    """
    buf = chunk.buf
    if not (((buf == 0xCC) | (buf == 0xCD)).any() or b"<|" in buf.tobytes()):
        buf = LOWER[buf]
    inside = ~SPACE[buf]
    start, end = inside.copy(), inside.copy()
    if len(buf):
        kind = KIND[buf]
        cut = (kind[1:] + kind[:-1]) == 3  # letter and sign, either way round
        start[1:] &= ~inside[:-1] | cut
        end[:-1] &= ~inside[1:] | cut
        at = chunk.offsets[(chunk.offsets > 0) & (chunk.offsets < len(buf))]
        start[at] = inside[at]
        end[at - 1] = inside[at - 1]
    return buf, np.flatnonzero(start), np.flatnonzero(end) + 1


class WordTokens:
    """Token ids of runs, kept for the task's process up to a bound."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.clear()

    def clear(self) -> None:
        self.index: dict[int, int] = {}
        self.first = np.zeros(1 << 16, np.int64)
        self.count = np.zeros(1 << 16, np.int64)
        self.ids = np.zeros(1 << 18, np.uint32)
        self.used = 0

    def add(self, hashes: list[int], texts: list[str]) -> None:
        for a in range(0, len(texts), 10_000):
            found = self.found(texts[a:a + 10_000])
            sizes = np.array([len(x) for x in found], np.int64)
            n, total = len(self.index), int(sizes.sum())
            while n + len(found) > len(self.first):
                self.first, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.count))
            while self.used + total > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            self.ids[self.used:self.used + total] = np.fromiter(chain.from_iterable(found), np.uint32, total)
            self.count[n:n + len(found)] = sizes
            self.first[n:n + len(found)] = self.used + np.cumsum(sizes) - sizes
            self.used += total
            self.index.update(zip(hashes[a:a + 10_000], range(n, n + len(found))))

    def found(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text. Letters alone go straight to the model, which costs less than half."""
        ids: list[list[int]] = []
        rest = []
        for i, text in enumerate(texts):
            if LETTERS.fullmatch(text):
                text = text.lower()
                if not text.isascii():
                    text = text.encode().decode("latin-1").translate(BYTE_CHARS)
                ids.append([t.id for t in self.model.tokenize(text)])
            else:
                ids.append([])
                rest.append(i)
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False)):
            ids[i] = e.ids
        return ids

    def encode(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number of ids of each word)."""
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        known, where, back = np.unique(PrefixHash(buf).of(starts, ends), return_index=True, return_inverse=True)
        if len(self.index) + len(known) > CACHED_WORDS:
            self.clear()
        keys = known.tolist()
        at = np.fromiter(map(self.index.get, keys, repeat(-1)), np.int64, len(keys))
        new = np.flatnonzero(at < 0)
        if len(new):
            data = buf.tobytes()
            spans = zip(starts[where[new]].tolist(), ends[where[new]].tolist())
            at[new] = len(self.index) + np.arange(len(new))
            self.add([keys[i] for i in new.tolist()], [data[a:b].decode("utf-8", "replace") for a, b in spans])
        at = at[back]
        sizes = self.count[at]
        total = np.cumsum(sizes)
        return self.ids[np.arange(total[-1]) + np.repeat(self.first[at] - total + sizes, sizes)], sizes


LOADED: dict[str, WordTokens] = {}


def tokenized(path: str, capacity: int, end_id: int, with_ids: bool):
    """Task body: the pieces of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in LOADED:
            LOADED[path] = WordTokens(path)
        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for chunk in text_chunks(batch.column("text")):
                buf, starts, ends = token_runs(chunk)
                ids, sizes = LOADED[path].encode(buf, starts, ends)
                total = np.concatenate([[0], np.cumsum(sizes)])
                bounds = total[np.searchsorted(starts, chunk.offsets)]
                rows = []
                for r in range(chunk.n):
                    own = np.append(ids[bounds[r]:bounds[r + 1]], np.uint32(end_id))
                    for p, a in enumerate(range(0, len(own), capacity)):
                        data = own[a:a + capacity].astype("<u4").tobytes()
                        rows.append((doc_ids[chunk.first + r], p, a, len(data) // 4, zlib.crc32(data), data))
                cols = list(zip(*rows))
                arrays = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), *[pa.int64()] * 3))]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    arrays, names = [*arrays, pa.array(cols[5], pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(arrays, names=names)
    return run


def tokenize(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID,
             with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` ids of every row, with their little-endian 32-bit ids on demand."""
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
            .mapInArrow(tokenized(tokenizer, capacity, end_id, with_ids), PIECES + ", ids binary" * with_ids))


def price(sizes: np.ndarray, value: np.ndarray, capacity: int) -> np.ndarray:
    """Unbounded knapsack: for each space, the class put in first by the best filling (-1: none)."""
    best = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1, np.int64)
    by_size = np.full(capacity + 1, -1, np.int64)
    by_size[sizes] = np.arange(len(sizes))
    worth = np.full(capacity + 1, -1.0)
    worth[sizes] = value
    for c in range(1, capacity + 1):
        total = best[c - 1::-1] + worth[1:c + 1]  # piece of size s leaves c - s
        s = int(total.argmax()) + 1
        if total[s - 1] > best[c - 1]:
            best[c], choice[c] = total[s - 1], by_size[s]
        else:
            best[c], choice[c] = best[c - 1], choice[c - 1] if choice[c - 1] >= 0 else -1
    return choice


class Plan:
    """Where the pieces of each length go: runs of equal configurations, then single places."""

    def __init__(self, lengths: np.ndarray, counts: np.ndarray, capacity: int) -> None:
        # Full pieces have a sequence each.
        part = lengths < capacity
        self.bins = int(counts[~part].sum())
        self.capacity, self.sizes, self.total = capacity, lengths[part].astype(np.int64), counts[part].astype(np.int64)
        self.runs: list[tuple[int, int, int, int, int]] = []  # class, first place, first sequence, pieces each, slot
        used = np.zeros(len(self.sizes), np.int64)
        self.by_program(used)
        self.placed = int(used.sum())
        self.best_fit(used)

    def by_program(self, used: np.ndarray) -> None:
        """Solves and rounds the configuration program: in each round every length places half of what it has left.

        Lengths of one ``grain`` have a weight together (each its own, if they are few). A step prices a filling
        the rest of a sequence behind the longest piece, gives it exact lengths
        and uses it as often as they last; weights fall by the part of a
        round's pieces that are placed, so that lengths which lag behind are
        worth more. A piece whose filling leaves more than ``slack`` tokens is
        put off to the next round; ``slack`` grows when a round places little.
        """
        grain, slack = -(-self.capacity // GROUPS) if len(self.sizes) > GROUPS else 1, 0
        space = self.capacity // grain
        group = -(-self.sizes // grain)
        rest, step = self.total.copy(), 0
        while rest.sum() > min(REST, self.total.sum() // 20):
            free = -(-rest // 2)
            if (free * self.sizes).sum() < 2 * self.capacity:
                free = rest.copy()  # not worth two rounds
            share = np.maximum(np.bincount(group, weights=free, minlength=space + 2), 1e-9)
            before = rest.sum()
            for first in range(len(free) - 1, -1, -1):  # the longest first
                while free[first]:
                    if step % PRICED_STEPS == 0:
                        left = np.bincount(group, weights=free, minlength=space + 2)
                        live = np.flatnonzero(left[:space + 1])
                        value = live * np.exp(RATE * (left[live] / share[live] - 1))
                        choice = price(live, value, space) if len(live) else np.full(space + 1, -1)
                    step += 1
                    config, waste = self.filling(first, live, choice, free, group, grain)
                    if waste > slack:
                        break
                    times = int(min(free[c] // n for c, n in config.items()))
                    self.place(config, times, used)
                    for c, n in config.items():
                        free[c] -= times * n
                        rest[c] -= times * n
            if (before - rest.sum()) * 8 < before:
                slack = min(2 * slack + 1, self.capacity)

    def filling(self, first: int, live: np.ndarray, choice: np.ndarray, free: np.ndarray, group: np.ndarray,
                grain: int) -> tuple[dict[int, int], int]:
        """The priced filling behind a first piece in exact lengths, ``({class: pieces}, tokens left)``.

        Of a group, the length with most pieces is taken; the last piece is the longest that fits.
        """
        taken = free.copy()
        taken[first] -= 1
        pieces, room = [first], self.capacity - int(self.sizes[first])
        at = room // grain
        while at > 0 and choice[at] >= 0:
            g = int(live[choice[at]])
            start, end = np.searchsorted(group, [g, g + 1])
            c = int(start + taken[start:end].argmax())
            if taken[c] <= 0:
                at -= 1
                continue
            pieces.append(c)
            taken[c] -= 1
            room -= int(self.sizes[c])
            at = min(at - g, room // grain)
        if len(pieces) > 1:  # the last piece again, as long as can be
            taken[pieces[-1]] += 1
            room += int(self.sizes[pieces.pop()])
        while True:
            fits = np.flatnonzero(taken[:np.searchsorted(self.sizes, room, "right")])
            if not len(fits):
                return dict(Counter(pieces)), room
            pieces.append(int(fits[-1]))
            taken[fits[-1]] -= 1
            room -= int(self.sizes[fits[-1]])

    def place(self, config: dict[int, int], times: int, used: np.ndarray) -> None:
        slot = 0
        for c, n in sorted(config.items()):
            self.runs.append((c, int(used[c]), self.bins, n, slot))
            used[c] += times * n
            slot += n
        self.bins += times

    def best_fit(self, used: np.ndarray) -> None:
        """Best-fit decreasing of the pieces that the program left, at most ``REST``."""
        space: list[tuple[int, int]] = []  # (space left, sequence), sorted
        slots: dict[int, int] = {}
        for c in range(len(self.sizes) - 1, -1, -1):
            length = int(self.sizes[c])
            for place in range(int(used[c]), int(self.total[c])):
                at = bisect.bisect_left(space, (length, -1))
                left, bin_ = space.pop(at) if at < len(space) else (self.capacity, self.bins)
                if bin_ == self.bins:
                    self.bins += 1
                slots[bin_] = slots.get(bin_, -1) + 1
                self.runs.append((c, place, bin_, 1, slots[bin_]))
                if left > length:
                    bisect.insort(space, (left - length, bin_))

    def arrays(self) -> dict[str, np.ndarray]:
        runs = np.array(sorted(self.runs), np.int64).reshape(-1, 5)
        cls = np.zeros(self.capacity + 1, np.int64)
        cls[self.sizes] = np.arange(len(self.sizes))
        return {"cls": cls, "key": (runs[:, 0] << 44) + runs[:, 1], "first": runs[:, 1],
                "bin": runs[:, 2], "each": runs[:, 3].astype(np.int16), "slot": runs[:, 4].astype(np.int16)}


def local_ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task body: adds each row's rank among the earlier rows of its length in the partition."""
    seen: dict[int, int] = defaultdict(int)
    for batch in batches:
        length = batch.column("length").to_numpy()
        order = np.argsort(length, kind="stable")
        values, first, counts = np.unique(length[order], return_index=True, return_counts=True)
        rank = np.empty(len(length), np.int64)
        rank[order] = np.arange(len(length)) - np.repeat(first, counts) + np.repeat([seen[v] for v in values.tolist()], counts) \
            if len(length) else rank
        for v, c in zip(values.tolist(), counts.tolist()):
            seen[v] += c
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rank)], names=[*batch.schema.names, "rank"])


def placed(plan: dict[str, np.ndarray], capacity: int):
    """Task body: ``sequence_id`` and slot of each row by its length and rank."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            cls, place = plan["cls"][length], rank
            bin_, slot = rank.copy(), np.zeros(len(rank), np.int64)  # a full piece: the sequence of its rank
            part = length < capacity
            if part.any():
                run_ = np.searchsorted(plan["key"], (cls[part] << 44) + place[part], "right") - 1
                inside = place[part] - plan["first"][run_]
                bin_[part] = plan["bin"][run_] + inside // plan["each"][run_]
                slot[part] = plan["slot"][run_] + inside % plan["each"][run_]
            names = [c for c in batch.schema.names if c not in ("rank", "pid")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(bin_), pa.array(slot)],
                                             names=[*names, "sequence_id", "slot"])
    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (any columns, with ``length`` from 1 to ``capacity``) with ``sequence_id`` and ``offset``."""
    names = pieces.columns
    pieces = cut(pieces)
    ranked = cut(pieces.withColumn("pid", F.spark_partition_id())
                 .mapInArrow(local_ranks, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
                             + ", pid int, rank long"))
    counts = ranked.groupBy("length", "pid").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("skip", F.coalesce(F.sum("n").over(earlier), F.lit(0))).select("length", "pid", "skip")
    histogram = counts.groupBy("length").agg(F.sum("n").alias("n")).orderBy("length").toArrow()
    plan = Plan(histogram.column("length").to_numpy(), histogram.column("n").to_numpy(), capacity).arrays()
    whole = (ranked.join(offsets, ["length", "pid"]).withColumn("rank", F.col("rank") + F.col("skip"))
             .select(*names, "rank"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    found = whole.mapInArrow(placed(plan, capacity), fields + ", sequence_id long, slot long")
    so_far = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return (found.withColumn("offset", F.coalesce(F.sum("length").over(so_far), F.lit(0)).cast("long"))
            .select(*names, "sequence_id", "offset"))


def assemble(packed: DataFrame) -> DataFrame:
    """``(sequence_id, length, ids, doc_ids)``: the packed sequences themselves, of pieces with their ``ids``."""
    part = F.struct("offset", "length", "doc_id", "ids")
    rows = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    return rows.select("sequence_id", F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + p["length"]).alias("length"),
                       F.array_join(F.transform("parts.ids", F.hex), "").alias("hex"), F.col("parts.doc_id").alias("doc_ids")) \
        .select("sequence_id", "length", F.unhex("hex").alias("ids"), "doc_ids")
