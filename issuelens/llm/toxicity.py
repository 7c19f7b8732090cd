"""Toxicity score by a weighted lexicon.

A text is folded (compatibility forms, lower case, look-alike letters of other
scripts, digits and signs that stand for letters; i and l become one letter, as
the same signs stand for both; all else that is no letter becomes a blank) and
searched by an Aho-Corasick automaton for all entries at once. A digit or sign
at the edge of a word, or a sign or asterisk inside, may stand for a letter or
part words: a text with such places is searched in each reading. An entry is the start of a word, of 4 letters at
least, or a whole shorter word; a word counts with its heaviest entry, and not
at all inside an exception phrase (a fixed list). The sum is divided by the root of the length in hundreds of
words and goes through a logistic curve.

The entries and their weights (log odds of document counts) and the curve are
fitted on a bounded sample of labelled texts.

Defined results: a null or empty text has sum 0 and gets the curve's value
there; with no labelled text of a class every score is the share of label 1
(0.5 with no labels); equal texts get equal scores; an empty table gives an
empty result; other columns pass through, except that ``score`` and ``hits``
are added (columns of those names are replaced).
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from issuelens.llm.common import training_ids, with_ids
from issuelens.llm.compression import logistic, training_share

TRAIN_PER_CLASS = 2000
MIN_DOCS = 5
MIN_WEIGHT = 2.0
MAX_ENTRIES = 2000
PREFIXES = (4, 12)

#: Letters of other scripts and signs that look like a Latin letter.
LOOK_ALIKES = {
    "а": "a", "в": "b", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o",
    "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ɡ": "g", "ո": "n", "ѵ": "v", "ԝ": "w", "ӏ": "l",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u",
    "χ": "x", "ı": "i", "ł": "l", "ø": "o",
}
#: Digits and signs written for letters.
WRITTEN_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s",
               "!": "i", "|": "i", "l": "i"}  # 1, ! and | stand for i and for l, so these are one letter
#: Phrases in which a lexicon word means no insult.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "circus clown", "pond scum", "soap scum")

SIGNS = "".join(c for c in WRITTEN_FOR if c != "l")
LETTERS = str.maketrans(WRITTEN_FOR)
#: Places with two readings: signs before and after the letters of a word, and signs and asterisks between letters.
EDGES = tuple(map(re.compile, (rf"(?<= )[{SIGNS}]+(?=[^ {SIGNS}])", rf"(?<=[^ {SIGNS}])[{SIGNS}]+(?= )",
                               rf"(?<=[^ *{SIGNS}])[*@$!|]+(?=[^ *{SIGNS}])")))


class Fold(dict):
    """What becomes of a character: marks of letters and signs stay, what is not seen goes, the rest parts words."""

    def __missing__(self, code: int) -> int | None:
        c = chr(code)
        kind = unicodedata.category(c)
        self[code] = None if kind == "Cf" else code if kind[0] in "LM" or c in SIGNS or c == "*" else ord(" ")
        return self[code]


FOLD = Fold(str.maketrans({**LOOK_ALIKES, **{c: None for c in "​‌‍­⁠"}}))


def readings(text: str) -> list[str]:
    """The folded text between two blanks in each reading of its signs, first the one in which all stand for letters.

    Words are parted by blanks; a place is the same in all readings.
    """
    if not text.isascii() and not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFKC", text)
    text = f" {text.lower().translate(FOLD)} "
    if "*" in text:
        text = re.sub(r"(?<= )\*+|\*+(?= )", lambda m: " " * len(m[0]), text)
    found = [text]
    for edge in EDGES:
        if edge.search(text):
            found += [edge.sub(lambda m: " " * len(m[0]), t) for t in found]
    return [t.translate(LETTERS) for t in found]


def fold(text: str) -> str:
    """The folded text with all signs as letters."""
    return readings(text)[0]


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)  # entry, with the blank before it -> weight
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: np.ndarray = field(default_factory=lambda: np.array([0.0, 0.0]))

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for entry, w in self.weights.items():
            found.add_word(entry, (len(entry), w))
        for phrase in self.exceptions:
            key = f" {fold(phrase).strip()}"
            found.add_word(key, (len(key), None))
        found.make_automaton()
        return found


def hits(automaton: ahocorasick.Automaton, folded: str) -> dict[int, float]:
    """Heaviest entry at each word start, without words inside an exception phrase."""
    best: dict[int, float] = {}
    spans = []
    for end, (size, weight) in automaton.iter(folded):
        start = end - size + 1
        if weight is None:
            spans.append((start, end))
        elif weight > best.get(start, 0.0):
            best[start] = weight
    for a, b in spans:
        for start in [s for s in best if a <= s <= b]:
            del best[start]
    return best


def text_hits(automaton: ahocorasick.Automaton, folded: list[str]) -> dict[int, float]:
    """The hits of a text over its readings: a word counts once, with its heaviest entry in any reading."""
    best = hits(automaton, folded[0])
    for t in folded[1:]:
        for start, weight in hits(automaton, t).items():
            while t[start - 1] == " " != folded[0][start]:  # to the first of the signs that are blanks here
                start -= 1
            if weight > best.get(start, 0.0):
                best[start] = weight
    return best


def level(found: dict[int, float], folded: str) -> float:
    """Sum of the weights, normalised by the length in words."""
    return sum(found.values()) / (1 + (len(folded.split()) + 1) / 100) ** 0.5


def entries_of(text: str) -> set[str]:
    """Candidate entries of a text: beginnings of its words, each after a blank, and short words between blanks."""
    low, high = PREFIXES
    words = {w for t in readings(text) for w in t.split()}
    return {f" {w[:n]}" for w in words for n in range(low, min(len(w), high) + 1)} | {f" {w} " for w in words if len(w) < low}


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = TRAIN_PER_CLASS,
        exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """Lexicon and curve from at most ``per_class`` labelled texts of each class.

    Document counts of entries and the sums of the texts are made in Spark; the
    driver gets at most ``MAX_ENTRIES`` entries and one number for each text of
    the sample.
    """
    sample = with_ids(docs, training_ids(labels, label, per_class)).where("text is not null")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for batch in batches:
            for y, text in zip(batch.column("label").to_pylist(), batch.column("text").to_pylist()):
                total[y].update(entries_of(text))
                total[y][""] += 1
        for y, c in total.items():
            yield pa.record_batch({"entry": pa.array(list(c), pa.string()), "label": pa.array([y] * len(c), pa.int32()),
                                   "n": pa.array(list(c.values()), pa.int64())})

    counts = (sample.mapInArrow(counted, "entry string, label int, n long")
              .groupBy("entry").agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("toxic"),
                                    F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("clean"))
              .where(F.col("toxic") >= MIN_DOCS))
    rows = counts.orderBy((F.col("toxic") / (F.col("clean") + 1)).desc(), "entry").limit(MAX_ENTRIES + 1).collect()
    size = counts.where("entry = ''").head()
    share = training_share(labels, label)
    p = min(max(share, 1e-3), 1 - 1e-3)
    model = Lexicon(exceptions=exceptions, curve=np.array([0.0, np.log(p / (1 - p))]))
    if size is None or not size["clean"]:
        return model
    for r in rows:
        w = np.log((r["toxic"] + 0.5) / (size["toxic"] + 1)) - np.log((r["clean"] + 0.5) / (size["clean"] + 1))
        if r["entry"] and w >= MIN_WEIGHT:
            model.weights[r["entry"]] = float(w)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = model.automaton()
        for batch in batches:
            folded = [readings(t) for t in batch.column("text").to_pylist()]
            yield pa.record_batch({"label": batch.column("label"),
                                   "level": pa.array([level(text_hits(search, t), t[0]) for t in folded], pa.float64())})

    got = sample.mapInArrow(summed, "label int, level double").toArrow()
    x, y = got.column("level").to_numpy(), got.column("label").to_numpy().astype(float)
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    model.curve = logistic(x[:, None], y, weight, ridge=0.1)
    return model


def score(docs: DataFrame, model: Lexicon) -> DataFrame:
    """The rows of ``docs`` with ``score`` and ``hits`` (words that counted): a narrow map over whole texts."""
    names = [c for c in docs.columns if c.lower() not in ("score", "hits")]
    schema = T.StructType([*(docs.schema[c] for c in names), T.StructField("score", T.DoubleType()),
                           T.StructField("hits", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = model.automaton() if model.weights else None
        for batch in batches:
            x, n = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for i, t in enumerate(batch.column("text")):
                if search and t.is_valid:
                    folded = readings(t.as_py())
                    found = text_hits(search, folded)
                    x[i], n[i] = level(found, folded[0]), len(found)
            p = 1 / (1 + np.exp(-np.clip(model.curve[0] * x + model.curve[1], -30, 30)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(p), pa.array(n)],
                                             names=[*names, "score", "hits"])

    return docs.select(*names).mapInArrow(run, schema)
