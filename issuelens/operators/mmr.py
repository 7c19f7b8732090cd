"""Maximal-marginal-relevance selection inside one document (KEY-6, KEY-7), and its stored state (KEY-12).

Candidates are the distinct n-grams of a document in first-position order. A
phrase vector is the mean of its words' unit trigram vectors, the document
vector the mean over all n-gram occurrences (KEY-5). A selection needs a
document's ``Candidates``: the unit phrase vectors as a sparse matrix over
trigrams, and the document vector; it is one sparse product for the relevance
and one for each pick. What is stored of a document, whatever the seeds, is its
phrases and how often each occurs: the vectors of words are many times their
size and the same in all documents, so a task makes each once (``Words``).

A trigram is one integer of three code points, so sets of trigrams are sorted
and matched as numbers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Trigrams whose text a task remembers.
CACHED_GRAMS = 100_000
#: Words and trigrams from which a task forgets the vectors of the words that it has met.
CACHED_WORDS, CACHED_WORD_GRAMS = 200_000, 65_536
STATE = "n int, phrases array<string>, counts array<int>"


class Candidates(NamedTuple):
    """Phrase i is the unit vector ``dat[ptr[i]:ptr[i + 1]]`` at the places ``col`` of ``grams``; ``doc`` is dense over ``grams``.

    Those of ``Words`` are over all its trigrams and have no ``grams``.
    """

    phrases: Sequence[str]
    ptr: np.ndarray
    col: np.ndarray
    dat: np.ndarray
    grams: np.ndarray
    doc: np.ndarray


def word_vectors(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unit trigram vectors of all words at once: ``(grams, word, gram, weight)``, sorted by word and gram (a place in ``grams``)."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    code = np.frombuffer("".join([f"^{w}$" for w in words]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    at = gathered(np.cumsum(size + 2) - size - 2, size)
    grams, gram = np.unique((code[at] << 42) | (code[at + 1] << 21) | code[at + 2], return_inverse=True)
    key, count = np.unique(np.repeat(np.arange(len(words)) * len(grams), size) + gram, return_counts=True)
    word = key // len(grams)
    norm = np.sqrt(np.bincount(word, weights=count * count, minlength=len(words)))
    return grams, word, key - word * len(grams), count / norm[word]


def gathered(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated ``arange(start, start + length)`` of every stretch."""
    total = int(lengths.sum())
    return np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(total)


def candidates(tokens: Sequence[str], n: int) -> Candidates | None:
    """The candidates of a document; none if it has fewer than ``n`` tokens."""
    if len(tokens) < n:
        return None
    counts = phrase_counts(tokens, n)
    return of_counts(list(counts), np.fromiter(counts.values(), np.float64, len(counts)), n)


def phrase_counts(tokens: Sequence[str], n: int) -> Counter:
    """How often each n-gram occurs, by first position."""
    return Counter(tokens if n == 1 else [" ".join(tokens[i:i + n]) for i in range(len(tokens) - n + 1)])


def of_counts(phrases: list[str], times: np.ndarray, n: int) -> Candidates:
    """The candidates of a document whose phrases occur so many times."""
    parts = [(p,) for p in phrases] if n == 1 else [p.split(" ") for p in phrases]
    place = {w: i for i, w in enumerate(dict.fromkeys(w for p in parts for w in p))}
    grams, word, gram, weight = word_vectors(list(place))
    if n == 1:
        row, col, raw = word, gram, weight
    else:
        start = np.searchsorted(word, np.arange(len(place) + 1))
        start, size = start[:-1], np.diff(start)
        of = np.array([[place[w] for w in p] for p in parts], np.int64).reshape(len(phrases), n)
        rows, cols, vals = [], [], []
        for k in range(n):
            at = gathered(start[of[:, k]], size[of[:, k]])
            rows.append(np.repeat(np.arange(len(phrases)), size[of[:, k]]))
            cols.append(gram[at])
            vals.append(weight[at] / n)
        key, back = np.unique(np.concatenate(rows) * len(grams) + np.concatenate(cols), return_inverse=True)
        raw = np.bincount(back, weights=np.concatenate(vals))
        row, col = key // len(grams), key % len(grams)
    norm = np.sqrt(np.bincount(row, weights=raw * raw, minlength=len(phrases)))
    doc = np.bincount(col, weights=raw * times[row], minlength=len(grams)) / float(times.sum())
    return Candidates(phrases, np.searchsorted(row, np.arange(len(phrases) + 1)), col, raw / norm[row], grams, doc)


class Words:
    """The trigram vectors of the words that a task has met: one sparse table, each word's trigrams sorted as in its document's."""

    def __init__(self) -> None:
        self.place: dict[str, int] = {}
        self.gram_place: dict[int, int] = {}
        self.start = np.zeros(1, np.int64)
        self.col, self.raw, self.unit = np.zeros(0, np.int64), np.zeros(0), np.zeros(0)

    def learn(self, words: Sequence[str]) -> np.ndarray:
        """The places of the words; new ones are added."""
        new = list(dict.fromkeys(w for w in words if w not in self.place))
        if new:
            self._add(new)
        return np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))

    def _add(self, new: list[str]) -> None:
        grams, word, gram, raw = word_vectors(new)
        ids = np.array([self.gram_place.setdefault(g, len(self.gram_place)) for g in grams.tolist()], np.int64)
        norm = np.sqrt(np.bincount(word, weights=raw * raw, minlength=len(new)))
        for w in new:
            self.place[w] = len(self.place)
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(np.bincount(word, minlength=len(new)))])
        self.col, self.raw, self.unit = (np.concatenate(x) for x in ((self.col, ids[gram]), (self.raw, raw), (self.unit, raw / norm[word])))

    def candidates(self, phrases: pa.Array, at: np.ndarray, times: np.ndarray) -> Candidates:
        """``of_counts`` of single words, given with their places here, over all trigrams."""
        size = self.start[at + 1] - self.start[at]
        own = gathered(self.start[at], size)
        col = self.col[own]
        doc = np.bincount(col, weights=self.raw[own] * np.repeat(times, size), minlength=len(self.gram_place)) / float(times.sum())
        return Candidates(phrases, np.concatenate([[0], np.cumsum(size)]), col, self.unit[own], None, doc)

    def pull(self, seeds: Seeds) -> np.ndarray:
        """The seeds' vector; their words are known here."""
        out = np.zeros(len(self.gram_place))
        out[[self.gram_place[g] for g in seeds.grams.tolist()]] = seeds.weight
        return out


class Seeds:
    """The mean of the seeds' vectors, sorted by trigram."""

    def __init__(self, seeds: Sequence[str]) -> None:
        self.grams, _, gram, weight = word_vectors(seeds)
        self.weight = np.bincount(gram, weights=weight / len(seeds), minlength=len(self.grams))


def select(c: Candidates, top_n: int, diversity: float, seeds: Seeds | None) -> tuple[list[int], np.ndarray]:
    """Greedy MMR: ``(places of the picked candidates in order, relevance of all)``.

    With seeds the document vector is pulled towards them, ``(3 * doc +
    mean(seeds)) / 4`` (KEY-7). Ties go to the earlier candidate.
    """
    if seeds is None or not len(seeds.grams):
        return greedy(c, top_n, diversity)
    at = np.minimum(np.searchsorted(c.grams, seeds.grams), len(c.grams) - 1)
    there = c.grams[at] == seeds.grams
    pull = np.zeros(len(c.grams))
    pull[at[there]] = seeds.weight[there]
    return greedy(c, top_n, diversity, pull, float(((seeds.weight[~there] / 4.0) ** 2).sum()))


def greedy(c: Candidates, top_n: int, diversity: float, pull: np.ndarray | None = None, outside: float = 0.0) -> tuple[list[int], np.ndarray]:
    """``select`` with the seeds' vector over the candidates' trigrams, and the square of what it has outside them."""
    doc = c.doc if pull is None else (3.0 * c.doc + pull) / 4.0

    def product(vector: np.ndarray) -> np.ndarray:
        return np.add.reduceat(c.dat * vector[c.col], c.ptr[:-1])

    length = float(np.sqrt(doc @ doc + outside))
    n = len(c.phrases)
    relevance = np.round(product(doc) / length, 9) if length > 0 else np.zeros(n)
    chosen = [int(relevance.argmax())]
    free, near, last = np.ones(n, bool), np.full(n, -np.inf), np.zeros(len(doc))
    while len(chosen) < min(top_n, n):
        own = slice(c.ptr[chosen[-1]], c.ptr[chosen[-1] + 1])
        last[c.col[own]] = c.dat[own]
        near = np.maximum(near, product(last))
        last[c.col[own]] = 0.0
        free[chosen[-1]] = False
        score = np.round((1 - diversity) * relevance - diversity * near, 9)
        chosen.append(int(np.where(free, score, -np.inf).argmax()))
    return chosen, relevance


def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task body over ``(doc_id, tokens)``, sorted by id: ``(doc_id, gram, weight)``, the vector of each document (KEY-5)."""
    names: dict[int, str] = {}

    def name(gram: int) -> str:
        text = names.get(gram)
        if text is None:
            if len(names) >= CACHED_GRAMS:
                names.clear()
            text = names[gram] = chr(gram >> 42) + chr(gram >> 21 & 0x1FFFFF) + chr(gram & 0x1FFFFF)
        return text

    def vector(counts: Counter, n: int) -> tuple[list[str], np.ndarray]:
        grams, word, gram, weight = word_vectors(list(counts))
        times = np.fromiter(counts.values(), np.float64, len(counts))
        return [name(g) for g in grams.tolist()], np.bincount(gram, weights=times[word] * weight) / n

    def rows(docs: list, kind: pa.DataType) -> pa.RecordBatch:
        made = [vector(counts, n) for _, counts, n in docs]
        ids = pa.array([i for i, _, _ in docs], kind).take(pa.array(np.repeat(np.arange(len(docs)), [len(g) for g, _ in made])))
        return pa.RecordBatch.from_arrays(
            [ids, pa.array([g for grams, _ in made for g in grams], pa.string()), pa.array(np.concatenate([w for _, w in made]))],
            names=["doc_id", "gram", "weight"])

    docs, kind = [], None
    for batch in batches:
        ids, tokens = batch.column("doc_id"), batch.column("tokens")
        kind = ids.type
        for i in range(batch.num_rows):
            doc_id, own = ids[i].as_py(), tokens[i].as_py()
            if docs and docs[-1][0] == doc_id:
                docs[-1][1].update(own)
                continue
            if len(docs) >= 256:
                yield rows(docs, kind)
                docs = []
            docs.append((doc_id, Counter(own), len(own)))
    if docs:
        yield rows(docs, kind)


def stored(n: int):
    """Task body over ``(doc_id, tokens)``: the phrases and counts of each document that has any."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tokens = batch.column("doc_id"), batch.column("tokens")
            for a in range(0, batch.num_rows, 256):
                own = [(i, tokens[i].as_py() or ()) for i in range(a, min(a + 256, batch.num_rows))]
                made = [(i, phrase_counts(t, n)) for i, t in own if len(t) >= n]
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array([i for i, _ in made], pa.int64())), pa.array([n] * len(made), pa.int32()),
                     pa.array([list(c) for _, c in made], pa.list_(pa.string())), pa.array([list(c.values()) for _, c in made], pa.list_(pa.int32()))],
                    names=["doc_id", *(f.split()[0] for f in STATE.split(", "))])
    return run


def of_state(batch: pa.RecordBatch, words: Words) -> Iterator[Candidates]:
    """The candidates of the stored documents of a batch; ``words`` knows those of one word."""
    phrases, counts = batch.column("phrases"), batch.column("counts")
    ends, times = phrases.offsets.to_numpy(), counts.values.to_numpy().astype(np.float64)
    shift, flat, n = counts.offsets[0].as_py() - ends[0], phrases.values, batch.column("n").to_pylist()
    if 1 in n:
        coded = flat.dictionary_encode()
        at = words.learn(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
    for i in range(batch.num_rows):
        a, b = ends[i], ends[i + 1]
        own, often = flat[a:b], times[a + shift:b + shift]
        yield words.candidates(own, at[a:b], often) if n[i] == 1 else of_counts(own.to_pylist(), often, n[i])


def picked(top_n: int, diversity: float, seeds: Sequence[str], n: int | None):
    """Task body: ``(doc_id, rank, phrase, relevance)`` of stored candidates, or of ``tokens`` if ``n`` is given."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pull, words, vector = Seeds(seeds) if seeds else None, Words(), None
        for batch in batches:
            at, ranks, phrases, scores = [], [], [], []
            if len(words.place) > CACHED_WORDS or len(words.gram_place) > CACHED_WORD_GRAMS:
                words = Words()
            words.learn(list(seeds))
            vector = None
            found = of_state(batch, words) if n is None else (candidates(t.as_py() or (), n) for t in batch.column("tokens"))
            for i, c in enumerate(found):
                if c is None:
                    continue
                if c.grams is not None:
                    chosen, relevance = select(c, top_n, diversity, pull)
                else:
                    if pull and (vector is None or len(vector) != len(c.doc)):
                        vector = words.pull(pull)
                    chosen, relevance = greedy(c, top_n, diversity, vector)
                at += [i] * len(chosen)
                ranks += range(1, len(chosen) + 1)
                phrases += [str(c.phrases[k]) for k in chosen]
                scores += relevance[chosen].tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(at, pa.int64())), pa.array(ranks, pa.int32()), pa.array(phrases, pa.string()),
                 pa.array(scores, pa.float64())], names=["doc_id", "rank", "phrase", "relevance"])
    return run
