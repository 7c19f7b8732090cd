"""Benchmark decontamination by edit distance between benchmark items and windows of documents.

Texts are sequences of lower-cased words; a document contains an item if some
stretch of it is within ``max_edit`` times the item's words in word edits.

1. *Reach*: an edit breaks at most q of an item's runs of q words, so a match
   shares the other runs, at places that differ by no more than the edits. Only
   windows around so many shared runs can match (q-gram lemma); this loses
   nothing and is read off a table of the items' runs.
2. *Search*: the windows of the item's size at every start that the edits allow
   are embedded by CGK random walks (a walk repeats or skips on by a random bit
   of the current word, so edits become a bounded Hamming distance). Bit
   sampling: in each of ``tables`` rounds a window is a candidate if it agrees
   with the item in all of ``BITS`` sampled places of a walk. The number of
   rounds comes from the recall wanted at the edit bound.
3. *Verification*: exact edit distance of the item to the best stretch near the
   candidate.

Items go to the tasks in blocks of at most ``ITEM_BYTES``, one pass over the
documents for each block, so that what a task holds is bounded.

Defined results: a null or empty document contains nothing; an item without
words matches nothing, one with too few words for an edit matches exactly;
items or documents that repeat are each reported; of several stretches the
closest is reported, ties to the first; empty tables give an empty result;
other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from issuelens.llm.textbytes import U64, Chunk, PrefixHash, mix, runs, text_chunks

MAX_EDIT = 0.2
RECALL = 0.99
WALKS = 4
BITS = 3
#: Share of equal places of two embeddings at the edit bound, at least (measured in the tests).
AGREE = 0.5
#: Starts tried to each side of a shared run, at least (all of them up to this many edits).
STARTS = 16
#: Places of embeddings that a task holds at a time.
PLACES = 4_000_000
ITEM_BYTES = 4 << 20
RESULT = "doc_id long, item_id long, distance int, item_words int, start long, end long"

WORD = np.zeros(256, bool)
WORD[ord("a"):ord("z") + 1] = True
WORD[ord("0"):ord("9") + 1] = True
WORD[0x80:] = True


def tables(recall: float, agree: float = AGREE, bits: int = BITS) -> int:
    """Rounds of bit sampling after which a window at the edit bound is missed with probability ``1 - recall``."""
    return ceil(log(1 - recall) / log(1 - agree ** bits))


def word_hashes(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts, ends = runs(WORD[chunk.buf], chunk.offsets)
    return starts, ends, PrefixHash(chunk.buf).of(starts, ends)


@dataclass
class Item:
    item_id: int
    words: np.ndarray
    edits: int

    @property
    def run(self) -> int:
        """Words of the shortest run that survives the edits, 3 at most."""
        return min(3, ceil((len(self.words) - self.edits) / (self.edits + 1)))


def walk_seeds(walk: int, blocks: int) -> np.ndarray:
    """A random number for each 64 steps of a walk."""
    return mix(np.arange(1, blocks + 1, dtype=np.uint64) * U64(0x9E3779B97F4A7C15) + U64(walk + 11))


def walked(words: np.ndarray, begin: np.ndarray, end: np.ndarray, steps: int, walk: int) -> np.ndarray:
    """CGK embedding of the windows ``begin`` to ``end``: steps x windows.

    Step j gives the current word, or 0 after the end, and moves on if bit j of
    the word's random bits is set.
    """
    at = begin.copy()
    out = np.zeros((steps, len(begin)), np.uint64)
    last = max(len(words) - 1, 0)
    for block, seed in enumerate(walk_seeds(walk, -(-steps // 64))):
        bits = mix(words ^ seed)
        for j in range(64 * block, min(64 * block + 64, steps)):
            now = np.minimum(at, last)
            live = at < end
            out[j] = np.where(live, words[now], U64(0))
            at += live & ((bits[now] >> U64(j % 64)) & U64(1)).astype(bool)
    return out


def sampled(rounds: int) -> list[tuple[int, np.ndarray]]:
    """(round, places) of the bit sampling, places as shares of the 3 * length steps of a window."""
    rng = np.random.default_rng(1)
    return [(k, rng.random(BITS)) for k in range(rounds)]


def covered(words: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words that some window holds, and the windows' bounds among them."""
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, begin, 1)
    np.add.at(depth, end, -1)
    inside = np.cumsum(depth[:-1]) > 0
    place = np.concatenate([[0], np.cumsum(inside)])
    return words[inside], place[begin], place[begin] + end - begin


def signatures(words: np.ndarray, begin: np.ndarray, limit: np.ndarray, lengths: np.ndarray, rounds: int) -> np.ndarray:
    """A hash of the sampled places of every round: rounds x windows.

    Windows are embedded by length in parts of at most ``PLACES`` embedded
    places, so a long item costs memory in proportion to itself only.
    """
    out = np.zeros((rounds, len(begin)), np.uint64)
    words, begin, end = covered(words, begin, np.minimum(begin + lengths, limit))
    order = np.argsort(lengths, kind="stable")
    at = 0
    while at < len(order):
        count = np.searchsorted(3 * lengths[order[at:]] * np.arange(1, len(order) - at + 1), PLACES, "right")
        count = max(1, int(count))
        part = order[at:at + count]
        at += count
        column = np.arange(len(part))
        for walk in range(WALKS):
            own = walked(words, begin[part], end[part], 3 * int(lengths[part].max()), walk)
            for k, places in sampled(rounds):
                if k % WALKS == walk:
                    key = np.full(len(part), k, np.uint64)
                    for share in places:
                        key = mix(key * U64(31) + own[(share * 3 * lengths[part]).astype(np.int64), column])
                    out[k, part] = key
    return out


def closest(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(distance, start, end) of the stretch of ``text`` closest to ``item`` in word edits, ties to the first end."""
    n = len(text)
    cost, origin = np.zeros(n + 1, np.int64), np.arange(n + 1)
    place = np.arange(n + 1)
    for i, w in enumerate(item):
        replace = cost[:-1] + (text != w)
        delete = cost[1:] + 1
        use = replace <= delete
        best = np.concatenate([[i + 1], np.where(use, replace, delete)])
        start = np.concatenate([[0], np.where(use, origin[:-1], origin[1:])])
        # Insertions: best[j] = min over k <= j of best[k] + j - k.
        key = best - place
        low = np.minimum.accumulate(key)
        lead = np.concatenate([[True], key[1:] < low[:-1]])
        source = np.maximum.accumulate(np.where(lead, place, 0))
        cost, origin = low + place, start[source]
    end = int(cost.argmin())
    return int(cost[end]), int(origin[end]), end


class Searcher:
    """The items of a block with their run tables and embeddings."""

    def __init__(self, items: list[Item], rounds: int) -> None:
        self.items, self.rounds = items, rounds
        self.lengths = np.array([len(i.words) for i in items], np.int64)
        self.edits = np.array([i.edits for i in items], np.int64)
        self.runs: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        by_run: dict[int, list[int]] = defaultdict(list)
        for k, item in enumerate(items):
            by_run[item.run].append(k)
        for size, own in by_run.items():
            h = [self.grams(items[k].words, size) for k in own]
            hashes = np.concatenate(h)
            who = np.repeat(own, [len(x) for x in h])
            off = np.concatenate([np.arange(len(x)) for x in h])
            order = np.argsort(hashes, kind="stable")
            self.runs[size] = hashes[order], who[order], off[order]
        words = np.concatenate([i.words for i in items])
        end = np.cumsum(self.lengths)
        self.signed = signatures(words, end - self.lengths, end, self.lengths, rounds)

    @staticmethod
    def grams(words: np.ndarray, size: int) -> np.ndarray:
        n = max(0, len(words) - size + 1)
        key = np.full(n, size, np.uint64)
        for k in range(size):
            key = mix(key * U64(31) + words[k:k + n])
        return key

    def near(self, words: np.ndarray, row: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, row, start) of the windows around a run shared with an item, each once."""
        parts = []
        for size, (known, who, off) in self.runs.items():
            h = self.grams(words, size)
            if not len(h):
                continue
            ok = np.flatnonzero(row[:len(h)] == row[size - 1:size - 1 + len(h)])
            lo = np.searchsorted(known, h[ok], "left")
            hit = np.flatnonzero(known[np.minimum(lo, len(known) - 1)] == h[ok])
            if not len(hit):
                continue
            lo, at = lo[hit], ok[hit]
            count = np.searchsorted(known, h[at], "right") - lo
            pick = np.repeat(lo - np.cumsum(count) + count, count) + np.arange(count.sum())
            at = np.repeat(at, count)
            item, doc, start = who[pick], row[at], at - off[pick]
            # An edit breaks at most `size` of an item's runs; those left lie within the edits of each other.
            order = np.lexsort((start, doc, item))
            item, doc, start = item[order], doc[order], start[order]
            least = self.lengths[item] - size + 1 - size * self.edits[item]
            span = len(words) + 2 * int(self.lengths.max()) * 4
            key = (item * len(bounds) + doc) * span + start + int(self.lengths.max()) * 2
            slack = 2 * self.edits[item]
            near = np.searchsorted(key, key + slack, "right") - np.searchsorted(key, key - slack, "left")
            enough = near >= least
            parts.append(np.stack([item[enough], doc[enough], start[enough]]))
        if not parts:
            return (np.zeros(0, np.int64),) * 3
        item, doc, start = np.unique(np.concatenate(parts, axis=1), axis=1)
        # Starts that the edits allow; a long item's are taken in steps, which its embedding bears like a few edits.
        step = np.maximum(1, self.edits[item] // STARTS)
        side = -(-self.edits[item] // step)
        reach = 2 * side + 1
        shift = np.arange(reach.sum()) - np.repeat(np.cumsum(reach) - reach + side, reach)
        shift *= np.repeat(step, reach)
        item, doc, start = np.repeat(item, reach), np.repeat(doc, reach), np.repeat(start, reach) + shift
        start = np.clip(start, bounds[doc], bounds[doc + 1])
        return tuple(np.unique(np.stack([item, doc, start]), axis=1))

    def search(self, words: np.ndarray, row: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(row, item, distance, first word, last word + 1) of the closest stretch of each item in each row."""
        item, doc, start = self.near(words, row, bounds)
        signed = signatures(words, start, bounds[doc + 1], self.lengths[item], self.rounds)
        keep = (signed == self.signed[:, item]).any(axis=0)
        item, doc, start = item[keep], doc[keep], start[keep]
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        if len(item):
            # Neighbouring starts of an item are verified together.
            far = np.ones(len(item), bool)
            far[1:] = (item[1:] != item[:-1]) | (doc[1:] != doc[:-1]) | (np.diff(start) > self.lengths[item[1:]])
            first = np.flatnonzero(far)
            last = np.append(first[1:], len(item)) - 1
            for a, b in zip(first.tolist(), last.tolist()):
                k, r = int(item[a]), int(doc[a])
                e, m = int(self.edits[k]), int(self.lengths[k])
                lo, hi = max(int(bounds[r]), int(start[a]) - 2 * e), min(int(bounds[r + 1]), int(start[b]) + m + 2 * e)
                if np.isin(self.items[k].words, words[lo:hi]).sum() < m - e:  # more words missing than edits allowed
                    continue
                d, s, t = closest(self.items[k].words, words[lo:hi])
                if d <= e and t > s and (d, lo + s, lo + t) < best.get((r, k), (1 << 30, 0, 0)):
                    best[r, k] = d, lo + s, lo + t
        return [(r, k, *v) for (r, k), v in sorted(best.items())]


def item_block(rows: pa.Table, max_edit: float) -> list[Item]:
    out = []
    for chunk in text_chunks(pc.utf8_lower(rows.column("text").combine_chunks())):
        starts, _, h = word_hashes(chunk)
        bounds = np.searchsorted(starts, chunk.offsets)
        for r in range(chunk.n):
            words = h[bounds[r]:bounds[r + 1]]
            if len(words):
                out.append(Item(rows.column("item_id")[chunk.first + r].as_py(), words, int(max_edit * len(words))))
    return out


def found_in(searcher: Searcher):
    """Task body: the items in each document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for chunk in text_chunks(pc.utf8_lower(batch.column("text"))):
                starts, ends, h = word_hashes(chunk)
                bounds = np.searchsorted(starts, chunk.offsets)
                got = searcher.search(h, chunk.row_of(starts), bounds)
                if got:
                    r, k, d, s, t = (np.array(x) for x in zip(*got))
                    base = bounds[r]
                    yield pa.record_batch({
                        "doc_id": ids.take(pa.array(r + chunk.first)),
                        "item_id": pa.array([searcher.items[i].item_id for i in k], pa.int64()),
                        "distance": pa.array(d, pa.int32()), "item_words": pa.array(searcher.lengths[k], pa.int32()),
                        "start": pa.array(s - base), "end": pa.array(t - base)})
    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, max_edit: float = MAX_EDIT, recall: float = RECALL,
                 item_bytes: int = ITEM_BYTES) -> DataFrame:
    """``(doc_id, item_id, distance, item_words, start, end)``: each item that a document contains, with its word span."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = docs.sparkSession.createDataFrame([], RESULT)
    for block in item_blocks(benchmark, item_bytes):
        items = item_block(block, max_edit)
        if items:
            out = out.unionByName(docs.mapInArrow(found_in(Searcher(items, tables(recall))), RESULT))
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, max_edit: float = MAX_EDIT, recall: float = RECALL,
                   item_bytes: int = ITEM_BYTES) -> DataFrame:
    """The rows of ``docs`` that contain no item, with all their columns: a narrow filter for each block of items."""
    def clean(searcher: Searcher):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for chunk in text_chunks(pc.utf8_lower(batch.column("text"))):
                    starts, _, h = word_hashes(chunk)
                    for row, *_ in searcher.search(h, chunk.row_of(starts), np.searchsorted(starts, chunk.offsets)):
                        keep[chunk.first + row] = False
                yield batch.filter(pa.array(keep))
        return run

    for block in item_blocks(benchmark, item_bytes):
        items = item_block(block, max_edit)
        if items:
            docs = docs.mapInArrow(clean(Searcher(items, tables(recall))), docs.schema)
    return docs


def item_blocks(benchmark: DataFrame, item_bytes: int) -> Iterator[pa.Table]:
    """The items in blocks of about ``item_bytes``; one block is at the driver at a time."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    total = rows.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    parts = -(-total // item_bytes)
    for k in range(parts):
        yield rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).orderBy("item_id", "text").toArrow()
