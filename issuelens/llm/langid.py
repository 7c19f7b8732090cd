"""Language identification by unigram pieces, summed over all segmentations.

The pieces are those of a fixed public vocabulary; nothing is trained about
them but a probability of each piece in each language. The likelihood of a word
is the sum over every way to cut it into pieces (forward algorithm); training
is expectation maximisation with the same sums on a bounded sample of labelled
texts. A text's score for a language is the sum over its words, and the
prediction is the language with the best one (ties: the first by name).

Words are runs of ASCII letters and non-ASCII characters of the lower-cased
text. A run of more than ``SECTION`` bytes is scored in sections.

Defined results: a null text, or one without a letter, is ``und`` with score 1;
with no labelled text every text is ``und`` with score 0; equal texts get equal
results; an empty table gives an empty result; other columns pass through,
except that ``lang_pred`` and ``score`` are added (columns of those names are
replaced).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from issuelens.llm.common import excerpt, held_out
from issuelens.llm.textbytes import Chunk, PrefixHash, runs, text_chunks

UNKNOWN = "und"
TRAIN_PER_LANG = 200
TRAIN_MAX_BYTES = 20_000
ROUNDS = 3
SMOOTH = 0.01
SECTION = 32
MAX_PIECE = 12
MARK = "▁"
CACHED_WORDS = 500_000

LETTER = np.zeros(256, bool)
LETTER[ord("a"):ord("z") + 1] = True
LETTER[0x80:] = True


class Pieces:
    """The vocabulary: piece hashes with ids, for the start of a word and for its inside."""

    def __init__(self, pieces: list[str]) -> None:
        inside, start = {}, {}
        self.mark, self.unknown = 0, 1
        ids = 2
        for p in pieces:
            where, body = (start, p[len(MARK):]) if p.startswith(MARK) else (inside, p)
            data = body.encode()
            if body == body.lower() and 0 < len(data) <= MAX_PIECE and LETTER[np.frombuffer(data, np.uint8)].all() \
                    and data not in where:
                where[data] = ids
                ids += 1
        self.n = ids
        self.tables = []
        for group in (inside, start):
            text = np.frombuffer(b"".join(group), np.uint8)
            ends = np.cumsum([len(k) for k in group])
            h = PrefixHash(text).of(ends - np.array([len(k) for k in group]), ends)
            order = np.argsort(h)
            self.tables.append((h[order], np.array(list(group.values()))[order]))

    def find(self, h: np.ndarray, at_start: bool) -> np.ndarray:
        """Piece ids of the hashes, -1 where there is none."""
        known, ids = self.tables[int(at_start)]
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        return np.where(known[at] == h, ids[at], -1)


class Lattice:
    """All pieces of equally long words: ids by place and length, at the start both kinds."""

    def __init__(self, pieces: Pieces, hashes: PrefixHash, buf: np.ndarray, starts: np.ndarray, n: int) -> None:
        self.n, self.words = n, len(starts)
        self.steps: list[tuple[int, int, bool, np.ndarray]] = []  # from, to, after the mark, ids
        first = [(buf[starts + s] & 0xC0) != 0x80 for s in range(n)] + [np.ones(len(starts), bool)]
        for s in range(n):
            for m in range(1, min(MAX_PIECE, n - s) + 1):
                ok = np.flatnonzero(first[s] & first[s + m])
                if not len(ok):
                    continue
                h = hashes.of(starts[ok] + s, starts[ok] + s + m)
                one = np.full(len(starts), -1)
                one[ok] = pieces.find(h, False)
                if m <= 4:  # a single character that is no piece
                    alone = first[s].copy()
                    for k in range(1, m):
                        alone &= ~first[s + k]
                    one[alone & first[s + m] & (one < 0)] = pieces.unknown
                if (one >= 0).any():
                    self.steps.append((s, s + m, s == 0, one))
                if s == 0:
                    two = np.full(len(starts), -1)
                    two[ok] = pieces.find(h, True)
                    if (two >= 0).any():
                        self.steps.append((s, s + m, False, two))

    def forward(self, prob: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """``alpha[place, word, language]``; ``prob`` has a row of zeros at the end for no piece."""
        alpha = np.zeros((self.n + 1, self.words, prob.shape[1]))
        alpha[0] = 1
        for a, b, marked, ids in self.steps:
            alpha[b] += alpha[a] * prob[ids] * (mark if marked else 1.0)
        return alpha

    def expected(self, prob: np.ndarray, mark: np.ndarray, counts: np.ndarray, out: np.ndarray, mark_id: int) -> None:
        """Adds the expected uses of each piece in words seen ``counts[word, language]`` times."""
        alpha = self.forward(prob, mark)
        beta = np.zeros_like(alpha)
        beta[self.n] = 1
        for a, b, marked, ids in reversed(self.steps):
            beta[a] += beta[b] * prob[ids] * (mark if marked else 1.0)
        weight = counts / np.maximum(alpha[self.n], 1e-300)
        for a, b, marked, ids in self.steps:
            use = alpha[a] * beta[b] * prob[ids] * (mark if marked else 1.0) * weight
            for k in range(out.shape[1]):
                out[:, k] += np.bincount(ids + 1, weights=use[:, k], minlength=len(out) + 1)[1:]
                if marked:
                    out[mark_id, k] += use[:, k].sum()


def sections(starts: np.ndarray, ends: np.ndarray, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words cut into sections of at most ``SECTION`` bytes at character bounds: starts, ends, word of each."""
    word = np.arange(len(starts))
    long = np.flatnonzero(ends - starts > SECTION)
    if not len(long):
        return starts, ends, word
    new_s, new_e, new_w = [starts[ends - starts <= SECTION]], [ends[ends - starts <= SECTION]], [word[ends - starts <= SECTION]]
    for i in long:
        cuts, at = [], int(starts[i])
        while at < ends[i]:
            to = min(at + SECTION, int(ends[i]))
            while to < ends[i] and to > at + 1 and (buf[to] & 0xC0) == 0x80:
                to -= 1
            cuts.append((at, to))
            at = to
        new_s.append(np.array([c[0] for c in cuts]))
        new_e.append(np.array([c[1] for c in cuts]))
        new_w.append(np.full(len(cuts), i))
    order = np.argsort(np.concatenate(new_s), kind="stable")
    return tuple(np.concatenate(x)[order] for x in (new_s, new_e, new_w))


def lattices(pieces: Pieces, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 20_000):
    """(indices, lattice) over words of equal byte length."""
    hashes = PrefixHash(buf)
    size = ends - starts
    for n in np.unique(size):
        own = np.flatnonzero(size == n)
        for a in range(0, len(own), block):
            part = own[a:a + block]
            yield part, Lattice(pieces, hashes, buf, starts[part], int(n))


@dataclass
class Model:
    langs: list[str]
    pieces: Pieces
    prob: np.ndarray  # piece x language, and a last row of zeros

    def word_scores(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Log likelihood of each section in each language."""
        out = np.zeros((len(starts), len(self.langs)))
        for part, lattice in lattices(self.pieces, buf, starts, ends):
            out[part] = np.log(np.maximum(lattice.forward(self.prob, self.prob[self.pieces.mark])[-1], 1e-300))
        return out


def letter_runs(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    return runs(LETTER[chunk.buf], chunk.offsets)


def vocabulary(path: str) -> list[str]:
    """The ordinary pieces of a sentencepiece model file."""
    import sentencepiece
    p = sentencepiece.SentencePieceProcessor(model_file=path)
    return [p.id_to_piece(i) for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i))]


def fit(docs: DataFrame, vocab: list[str], per_lang: int = TRAIN_PER_LANG) -> Model:
    """Piece probabilities from about ``per_lang`` labelled texts of each language outside the held-out fold.

    Of a text with more than ``TRAIN_MAX_BYTES``, stretches with as many
    characters are used to fit. Spark counts the words of the sample; the driver gets these counts, bounded by the sample,
    and one number for each language.
    """
    rows = docs.where(F.col("lang").isNotNull() & (F.octet_length("text") > 0)
                      & ~held_out(F.col("doc_id"))).select("doc_id", "lang", "text")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    pieces = Pieces(vocab)
    if not langs:
        return Model([], pieces, np.zeros((pieces.n + 1, 0)))
    share = docs.sparkSession.createDataFrame(
        [(k, min(1.0, 2 * per_lang / n)) for k, n in sizes.items()], "lang string, share double")
    luck = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(5)), 11) / float(1 << 53)
    order = Window.partitionBy("lang").orderBy(luck, "doc_id", "text")
    # Twice the wanted number by chance, then exactly the first ones: the window never sees a whole language.
    sample = (rows.join(F.broadcast(share), "lang").where(luck < F.col("share"))
              .withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_lang)
              .select("lang", excerpt(F.col("text"), TRAIN_MAX_BYTES).alias("text")))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = np.array(batch.column("lang").to_pylist(), object)
            for chunk in text_chunks(pc.utf8_lower(batch.column("text"))):
                s, e = letter_runs(chunk)
                s, e, _ = sections(s, e, chunk.buf)
                row = chunk.row_of(s) + chunk.first
                data = chunk.buf.tobytes()
                yield pa.record_batch({"lang": pa.array(lang[row], pa.string()),
                                       "word": pa.array([data[a:b] for a, b in zip(s, e)], pa.binary())})

    got = (sample.mapInArrow(counted, "lang string, word binary").groupBy("lang", "word")
           .agg(F.count("*").alias("n")).orderBy("word", "lang").toArrow())
    words, back = np.unique(np.array(got.column("word").to_pylist(), object), return_inverse=True)
    counts = np.zeros((len(words), len(langs)))
    place = {k: i for i, k in enumerate(langs)}
    counts[back, [place[k] for k in got.column("lang").to_pylist()]] = got.column("n").to_numpy()
    buf = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    starts = ends - np.array([len(w) for w in words], np.int64)
    parts = list(lattices(pieces, buf, starts, ends)) if len(words) else []
    prob = np.full((pieces.n + 1, len(langs)), 1.0 / pieces.n)
    for _ in range(ROUNDS):
        prob[-1] = 0
        uses = np.full((pieces.n, len(langs)), SMOOTH)
        for part, lattice in parts:
            lattice.expected(prob, prob[pieces.mark], counts[part], uses, pieces.mark)
        prob[:-1] = uses / uses.sum(axis=0)
    prob[-1] = 0
    return Model(langs, pieces, prob)


class Cache:
    """Scores of words met by a task, up to a bound."""

    def __init__(self, model: Model) -> None:
        self.model, self.index, self.rows = model, {}, np.zeros((1 << 16, len(model.langs)))

    def scores(self, chunk: Chunk, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        known, where, back = np.unique(PrefixHash(chunk.buf).of(s, e), return_index=True, return_inverse=True)
        if len(self.index) + len(known) > CACHED_WORDS:
            self.index = {}
        keys = known.tolist()
        new = np.array([i for i, k in enumerate(keys) if k not in self.index], np.int64)
        if len(new):
            n = len(self.index)
            while n + len(new) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[n:n + len(new)] = self.model.word_scores(chunk.buf, s[where[new]], e[where[new]])
            self.index.update(zip((keys[i] for i in new), range(n, n + len(new))))
        return self.rows[np.array([self.index[k] for k in keys], np.int64)[back]]


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` with ``lang_pred`` and ``score`` (posterior under equal priors): a narrow map over whole texts."""
    names = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    schema = T.StructType([*(docs.schema[c] for c in names), T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, langs = Cache(model), np.array([*model.langs, UNKNOWN], object)
        for batch in batches:
            text = batch.column("text")
            for chunk in text_chunks(pc.utf8_lower(text)):
                total = np.zeros((chunk.n, len(model.langs)))
                s, e = letter_runs(chunk)
                letters = chunk.per_row(LETTER[chunk.buf] & (chunk.buf < 0x80)) > 0
                for r in np.flatnonzero(~letters):  # non-ASCII letters, or none
                    value = text[chunk.first + int(r)].as_py()
                    letters[r] = value is not None and any(c.isalpha() for c in value)
                if len(s) and model.langs:
                    s, e, _ = sections(s, e, chunk.buf)
                    found, row = cache.scores(chunk, s, e), chunk.row_of(s)
                    for k in range(len(model.langs)):
                        total[:, k] = np.bincount(row, weights=found[:, k], minlength=chunk.n)
                if model.langs:
                    best = total.argmax(axis=1)
                    p = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                else:
                    best, p = np.full(chunk.n, 0), np.zeros(chunk.n)
                best = np.where(letters, best, len(model.langs))
                p = np.where(letters, p, 1.0 if model.langs else 0.0)
                rows = batch.slice(chunk.first, chunk.n)
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in names), pa.array(langs[best], pa.string()),
                                                  pa.array(p, pa.float64())], names=[*names, "lang_pred", "score"])

    return docs.select(*names).mapInArrow(run, schema)
