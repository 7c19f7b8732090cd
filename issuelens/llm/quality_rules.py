"""Quality rules by line sequence labelling.

Each text is a sequence of lines. A linear-chain conditional random field with
two states (0 boilerplate, 1 content) scores every line by its features and
every step by a transition weight; Viterbi decoding marks the lines. A document
stays if the share of its words that stand in content lines reaches
``min_share`` and the two base rules hold (enough words, not too many repeated
three-word windows).

The field is trained here: the weights are the maximum of the conditional
likelihood, with a Gaussian prior around ``PRIOR``, on a bounded sample of
labelled documents whose lines carry the document's label. With no labels the
prior itself is used.

Defined results: a null or empty text has no words, so it is not kept; lines
without a word carry no words and do not change the share; equal rows get
equal results; an empty table gives an empty result; other columns pass through untouched, except
that ``rules`` is added (a column of that name is replaced). A long text costs memory in proportion to
itself and nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from issuelens.llm.common import training_ids, with_ids
from issuelens.llm.textbytes import U64, PrefixHash, Chunk, mix, repeated, row_keys, text_chunks, words

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_SHARE = 0.5
TRAIN_PER_CLASS = 600
TRAIN_MAX_LINES = 200

SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
UPPER = np.zeros(256, bool)
UPPER[ord("A"):ord("Z") + 1] = True
DIGIT = np.zeros(256, bool)
DIGIT[ord("0"):ord("9") + 1] = True
BANG = np.zeros(256, bool)
BANG[[ord("!"), ord("?")]] = True
END = np.zeros(256, bool)
END[[ord(c) for c in ".!?:;\"')"]] = True

FEATURES = ("bias", "symbol_share", "upper_share", "digit_share", "bang_share", "short", "long_words",
            "repeated_words", "duplicate", "no_end")
#: Weights of state 1 (content) against state 0, before training.
PRIOR = np.array([1.5, -8.0, -3.0, -3.0, -8.0, -0.3, -0.5, -1.0, -1.5, -0.3])
#: Log weight of staying in a state against leaving it, before training.
PRIOR_STAY = 1.0
BASE_SCHEMA = "word_chars long, n_words long, n_symbols long, n_dup_lines long, n_repeat_words long"


class Lines:
    """Counts of the rows and features of the lines of a chunk."""

    def __init__(self, chunk: Chunk) -> None:
        buf, n = chunk.buf, chunk.n
        starts, ends = words(chunk)
        hashes = PrefixHash(buf)
        rows = chunk.row_of(starts)
        word_bytes = np.zeros(len(buf) + 1, np.int64)
        inside = np.zeros(len(buf) + 1, np.int8)
        inside[starts] += 1
        inside[ends] -= 1
        inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
        first_byte = (buf & 0xC0) != 0x80
        np.cumsum(inside & first_byte, out=word_bytes[1:])
        self.n_words = np.bincount(rows, minlength=n)
        self.word_chars = word_bytes[chunk.offsets[1:]] - word_bytes[chunk.offsets[:-1]]
        self.n_symbols = chunk.per_row(SYMBOL[buf])
        covered = self.repeat_mask(hashes.of(starts, ends), rows)
        self.n_repeat_words = np.bincount(rows[covered], minlength=n)

        # Lines: every text has one more line than it has line feeds.
        feeds = np.flatnonzero(buf == 10)
        owner = chunk.row_of(feeds)
        line_row = np.sort(np.concatenate([np.arange(n), owner]), kind="stable")
        line_start = np.sort(np.concatenate([chunk.offsets[:-1], feeds + 1]), kind="stable")
        line_end = np.sort(np.concatenate([chunk.offsets[1:], feeds]), kind="stable")
        word_line = np.searchsorted(line_start, starts, "right") - 1
        self.line_words = np.bincount(word_line, minlength=len(line_start))
        kept = np.flatnonzero(self.line_words > 0)
        self.row, self.words = line_row[kept], self.line_words[kept]
        a, b = line_start[kept], line_end[kept]
        _, later = repeated(row_keys(self.row, hashes.of(a, b)))
        self.n_dup_lines = np.bincount(self.row[later], minlength=n)
        self.n = n

        def share(mask: np.ndarray) -> np.ndarray:
            total = np.zeros(len(buf) + 1, np.int64)
            np.cumsum(mask, out=total[1:])
            return (total[b] - total[a]) / chars

        chars = np.maximum(word_bytes[b] - word_bytes[a], 1).astype(float)
        repeat_share = np.bincount(word_line[covered], minlength=len(line_start))[kept] / self.words
        last = np.zeros(len(line_start), np.int64)
        last[word_line] = ends  # the last word of each line wins
        self.x = np.stack([
            np.ones(len(kept)), np.minimum(share(SYMBOL[buf]) * 4, 2), share(UPPER[buf]), share(DIGIT[buf]),
            np.minimum(share(BANG[buf]) * 4, 2), self.words <= 2, np.minimum(chars / self.words / 10, 4),
            repeat_share, later.astype(float), ~END[buf[last[kept] - 1]]], axis=1).astype(np.float64)
        self.x *= np.clip(np.log2(1 + self.words) / 4, 0.25, 3)[:, None]  # a long line is more evidence

    @staticmethod
    def repeat_mask(h: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Words in a three-word window that the same row has twice or more."""
        covered = np.zeros(len(h), bool)
        if len(h) >= 3:
            same = rows[2:] == rows[:-2]
            key = h[:-2] + mix(h[1:-1] + mix(h[2:] + U64(7)))
            at = np.flatnonzero(same)
            twice, _ = repeated(row_keys(rows[at], key[at]))
            at = at[twice]
            for k in range(3):
                covered[at + k] = True
        return covered


def viterbi(emit: np.ndarray, stay: float, rows: np.ndarray, n: int) -> np.ndarray:
    """Best state of every line; ``emit`` is the score of state 1 against state 0, lines of a row stand together.

    All rows step through their lines together, longest first. A tie goes to content.
    """
    counts = np.bincount(rows, minlength=n)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    order = np.argsort(-counts, kind="stable")
    live = np.searchsorted(-counts[order], -np.arange(1, (counts.max(initial=0)) + 1), "right")
    score = np.zeros((n, 2))
    back = np.zeros((len(rows), 2), np.int8)
    for t, k in enumerate(live):
        own = order[:k]
        at = first[own] + t
        s0, s1 = score[own, 0], score[own, 1]
        if t:
            from0, from1 = s0 + stay < s1, s1 + stay >= s0
            back[at, 0], back[at, 1] = from0, from1
            s0, s1 = np.maximum(s0 + stay, s1), np.maximum(s1 + stay, s0)
        score[own, 0], score[own, 1] = s0, s1 + emit[at]
    state = np.zeros(len(rows), np.int8)
    current = (score[:, 1] >= score[:, 0]).astype(np.int8)
    for t in range(len(live) - 1, -1, -1):
        own = order[:live[t]]
        at = first[own] + t
        state[at] = current[own]
        current[own] = back[at, current[own]]
    return state


def train(x: np.ndarray, y: np.ndarray, rows: np.ndarray, steps: int = 60, rate: float = 0.5,
          strength: float = 0.02) -> tuple[np.ndarray, float]:
    """Weights and stay weight of the chain that maximise the penalised conditional likelihood.

    Gradients are exact (forward-backward in log space over all rows at once);
    ``strength`` pulls the weights to the prior.
    """
    weights, stay = PRIOR.copy(), PRIOR_STAY
    if not len(y):
        return weights, stay
    ids, rows = np.unique(rows, return_inverse=True)
    counts = np.bincount(rows)
    n, longest = len(ids), counts.max()
    place = np.arange(len(rows)) - np.repeat(np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    there = np.zeros((n, longest), bool)
    there[rows, place] = True
    same = np.zeros(len(rows), bool)
    same[1:] = (rows[1:] == rows[:-1]) & (y[1:] == y[:-1])
    balance = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    row_weight = np.zeros(n)
    np.add.at(row_weight, rows, balance)
    row_weight /= counts
    size = np.full(len(weights) + 1, 1e-8)
    for _ in range(steps):
        emit = np.zeros((n, longest))
        emit[rows, place] = x @ weights
        forward = np.zeros((longest, n, 2))
        forward[0, :, 1] = emit[:, 0]
        for t in range(1, longest):
            a0, a1 = forward[t - 1, :, 0], forward[t - 1, :, 1]
            new = np.stack([np.logaddexp(a0 + stay, a1), np.logaddexp(a1 + stay, a0) + emit[:, t]], 1)
            forward[t] = np.where(there[:, t, None], new, forward[t - 1])
        backward = np.zeros((longest, n, 2))
        pair = np.zeros((longest, n))
        total = np.logaddexp(forward[-1, :, 0], forward[-1, :, 1])
        for t in range(longest - 2, -1, -1):
            b0, b1 = backward[t + 1, :, 0], backward[t + 1, :, 1] + emit[:, t + 1]
            new = np.stack([np.logaddexp(b0 + stay, b1), np.logaddexp(b1 + stay, b0)], 1)
            live = there[:, t + 1]
            stays = np.logaddexp(forward[t, :, 0] + b0, forward[t, :, 1] + b1) + stay - total
            pair[t + 1] = np.where(live, np.exp(np.minimum(stays, 0)), 0)
            backward[t] = np.where(live[:, None], new, 0)
        posterior = np.exp(np.minimum(forward[:, :, 1] + backward[:, :, 1] - total, 0)).T[rows, place]
        grad = np.append(((y - posterior) * row_weight[rows]) @ x - strength * (weights - PRIOR) * 0.05,
                         ((same - pair.T[rows, place]) * row_weight[rows]).sum() - 0.1 * (stay - PRIOR_STAY))
        size += grad ** 2
        step = rate * grad / np.sqrt(size)
        weights = weights + step[:-1]
        stay = float(np.clip(stay + step[-1], 0.0, 6.0))
    return weights, stay


def in_stretches(row: np.ndarray, n: int, parts: int = 4) -> np.ndarray:
    """Which lines are used to fit: all of a row, or ``parts`` stretches at even places with ``TRAIN_MAX_LINES`` in all."""
    count = np.bincount(row, minlength=n)
    place = np.arange(len(row)) - (np.cumsum(count) - count)[row]
    size, lines = TRAIN_MAX_LINES // parts, count[row]
    use = lines <= TRAIN_MAX_LINES
    for k in range(parts):
        start = k * (lines - size) // (parts - 1)
        use |= (place >= start) & (place < start + size)
    return use


def fit(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_PER_CLASS) -> tuple[np.ndarray, float]:
    """Train on at most ``per_class`` labelled documents of each class; of one with more than ``TRAIN_MAX_LINES`` lines, on four stretches.

    Spark computes the line features; the driver gets at most
    ``2 * per_class * TRAIN_MAX_LINES`` feature rows.
    """
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, label = batch.column("doc_id").to_numpy(), batch.column("label").to_numpy()
            for chunk in text_chunks(batch.column("text")):
                got = Lines(chunk)
                use = in_stretches(got.row, chunk.n)
                row = got.row[use] + chunk.first
                yield pa.record_batch({"doc_id": pa.array(ids[row]), "label": pa.array(label[row]),
                                       "x": pa.array(list(got.x[use]), pa.list_(pa.float64()))})

    sample = with_ids(docs, training_ids(labels, "quality", per_class)).select(
        F.col("doc_id").cast("long").alias("doc_id"), "label", "text")
    got = sample.mapInArrow(features, "doc_id long, label int, x array<double>").toArrow().to_pandas()
    if not len(got):
        return PRIOR.copy(), PRIOR_STAY
    got = got.sort_values("doc_id", kind="stable")
    return train(np.stack(got["x"].to_numpy()), got["label"].to_numpy(), got["doc_id"].to_numpy())


def judge(docs: DataFrame, model: tuple[np.ndarray, float], min_share: float = MIN_SHARE,
          min_words: int = MIN_WORDS, max_repeat: int = MAX_REPEAT_PERCENT) -> DataFrame:
    """All columns of ``docs`` (with a ``text``) and the struct ``rules`` with counts, share and verdict.

    A narrow map: one pass over the rows, no shuffle.
    """
    weights, stay = model
    names = [c for c in docs.columns if c.lower() != "rules"]
    rules = T.StructType.fromDDL(f"{BASE_SCHEMA}, base_failed boolean, content_share double, kept boolean")
    out = T.StructType([*(docs.schema[c] for c in names), T.StructField("rules", rules)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in text_chunks(batch.column("text")):
                got = Lines(chunk)
                state = viterbi(got.x @ weights, stay, got.row, chunk.n)
                content = np.bincount(got.row, weights=got.words * state, minlength=chunk.n)
                share = content / np.maximum(got.n_words, 1)
                failed = (got.n_words < min_words) | (100 * got.n_repeat_words > max_repeat * got.n_words)
                found = pa.StructArray.from_arrays(
                    [pa.array(v) for v in (got.word_chars, got.n_words, got.n_symbols, got.n_dup_lines,
                                           got.n_repeat_words, failed, share, ~failed & (share >= min_share))],
                    ["word_chars", "n_words", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                     "content_share", "kept"])
                rows = batch.slice(chunk.first, chunk.n)
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in names), found], names=[*names, "rules"])

    return docs.select(*names).mapInArrow(run, out)


def quality_rules(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_PER_CLASS,
                  min_share: float = MIN_SHARE) -> DataFrame:
    """Train on ``labels`` and judge every row of ``docs``: its columns and the struct ``rules``."""
    return judge(docs, fit(docs, labels, per_class), min_share)
