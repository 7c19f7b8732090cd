"""Term vectors and cosine similarity (KEY-3 b, KEY-4).

The default vector of a term is its character-trigram count vector: pad the
term to ``^term$`` and take every 3-character substring (a one-letter term
gives one gram). ``cos(a, b) = sum(cnt_a * cnt_b) / sqrt(|a|^2 * |b|^2)``,
0 when no gram is shared. Dot products and norms are integers and the
quotient is one IEEE expression, so every engine computes identical bits and
orderings agree without rounding.

Scoring against a keyword set is an in-row expression: the keyword list is one
literal, so each term is scored by a map lookup per gram, with no join and no
shuffle, whatever the number of keywords.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Sequence
from math import sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

SIM_DECIMALS = 9


def py_char_grams(term: str) -> list[str]:
    """Trigrams of ``^term$`` (used for the literal keyword side only)."""
    p = "^" + term + "$"
    return [p[i:i + 3] for i in range(len(p) - 2)]


def char_grams(term: Column) -> Column:
    """``array<string>`` of the trigrams of ``^term$``, with repeats."""
    p = F.concat(F.lit("^"), term, F.lit("$"))
    return F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substring(p, i, 3))


class KeywordSet:
    """A bounded, ordered literal keyword list prepared for in-row scoring.

    ``groups`` maps a group name (a labelling method, or one known-keyword
    set) to its ordered keywords; ``kid`` is the position inside its group.
    """

    def __init__(self, groups: dict[str, Sequence[str]]):
        self.groups = {g: list(kws) for g, kws in groups.items()}
        self.flat: list[tuple[str, int, str]] = [
            (g, i, kw) for g, kws in self.groups.items() for i, kw in enumerate(kws)]
        if not self.flat:
            raise ValueError("empty keyword set")
        counts = [Counter(py_char_grams(kw)) for _, _, kw in self.flat]
        grams = sorted(set().union(*counts))
        self.norm2 = [sum(v * v for v in c.values()) for c in counts]
        # gram -> per-keyword counts (dense over all keywords of all groups)
        self.gram_counts = {g: [c.get(g, 0) for c in counts] for g in grams}
        self.offsets: dict[str, tuple[int, int]] = {}
        pos = 0
        for g, kws in self.groups.items():
            self.offsets[g] = (pos, len(kws))
            pos += len(kws)

    def _gram_map(self) -> Column:
        """Two-level literal map: first two characters -> (gram -> per-keyword counts).

        Spark looks up a literal map by scanning its keys, so splitting by the
        first characters cuts a lookup from all keyword grams to a few. The map
        is one JSON literal that Catalyst folds, so a plan with thousands of
        keywords has no more nodes than one with ten.
        """
        by_first: dict[str, dict[str, list[int]]] = {}
        for g, v in self.gram_counts.items():
            by_first.setdefault(g[:2], {})[g] = v
        return F.from_json(F.lit(json.dumps(by_first)), "map<string,map<string,array<int>>>")

    @staticmethod
    def _lookup(gmap: Column, gram: Column) -> Column:
        return F.element_at(F.element_at(gmap, F.substring(gram, 1, 2)), gram)

    def sims_of(self, terms: Column) -> Column:
        """``array<array<double>>``: per term, the rounded cosine to every keyword.

        Works on a whole term array so that every intermediate (grams, dot
        products, squared norm) reaches the next step as a lambda variable. An
        outer expression referenced inside a lambda body is re-evaluated for
        each element, which turns a linear scorer quadratic.
        """
        k = len(self.flat)
        zeros = F.array_repeat(F.lit(0), k)
        gmap = self._gram_map()
        known = list(self.gram_counts)
        kn = F.from_json(F.lit(json.dumps(self.norm2)), "array<int>")
        with_grams = F.transform(terms, lambda t: char_grams(t))

        def add_hit(acc, x):
            return F.zip_with(acc, self._lookup(gmap, x), lambda a, b: a + b)

        def hits(g):
            # `isin` is a hash set: a gram that no keyword holds (the common
            # case) reaches neither the map nor the accumulator
            return F.filter(g, lambda x: x.isin(known))

        def norm2(g):
            # without repeated grams the squared norm is the gram count
            return F.when(F.size(g) == F.size(F.array_distinct(g)), F.size(g).cast("long")).otherwise(
                F.aggregate(g, F.lit(0).cast("long"), lambda acc, x: acc + F.size(F.filter(g, lambda h: h == x))))

        stats = F.transform(with_grams, lambda g: F.struct(
            F.aggregate(hits(g), zeros, add_hit).alias("dots"), norm2(g).alias("n2")))
        # integer dot products and one IEEE formula: the same bits in every engine,
        # so no rounding is needed before ordering
        return F.transform(stats, lambda st: F.zip_with(st["dots"], kn, lambda d, m: (
            d.cast("double") / F.sqrt((st["n2"] * m).cast("double")))))

    def sims(self, term: Column) -> Column:
        """``array<double>``: rounded cosine of one term to every keyword."""
        return F.element_at(self.sims_of(F.array(term)), 1)

    def best(self, sims: Column, group: str) -> Column:
        """struct<sim double, nkid int, keyword string>: best keyword of one group
        (``nkid`` is minus the list position).

        Order: similarity descending, then list position ascending.
        """
        start, n = self.offsets[group]
        kws = F.from_json(F.lit(json.dumps(self.groups[group])), "array<string>")
        return bind(sims, lambda s: F.array_max(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.struct(
            F.element_at(s, j + start + 1).alias("sim"), (-j).alias("nkid"),
            F.element_at(kws, j + 1).alias("keyword")))))

    def best_of(self, terms: Column) -> Column:
        """struct of ``struct<sim double, npos int, keyword string>`` for each group: the best term of an array.

        Order: similarity descending, then place of the term (``npos`` is minus
        it) ascending, the keyword of a term being its ``best``. An array without
        terms has nulls. Terms repeat over rows, so a task scores each once, as
        integers by the formula of ``sims_of``, and a row's best is a reduction
        of whole Arrow batches.
        """
        groups = {g: (self.offsets[g], self.groups[g]) for g in self.groups}
        score = _scorer(self.gram_counts, self.norm2, [r for r, _ in groups.values()])

        def best(chunks):
            import numpy as np
            import pyarrow as pa

            ends = chunks.offsets.to_numpy()
            coded = chunks.values.slice(ends[0], ends[-1] - ends[0]).dictionary_encode()
            found = [score(t) for t in coded.dictionary.to_pylist()]
            code, start, size = coded.indices.to_numpy(), ends[:-1] - ends[0], np.diff(ends)
            full = np.flatnonzero(size)
            out = []
            for j, (_, kws) in enumerate(groups.values()):
                sim = np.zeros(len(chunks))
                at = np.zeros(len(chunks), np.int64)
                kid = np.zeros(len(chunks), np.int64)
                if len(full):
                    sims = np.array([f[j][0] for f in found])[code]
                    top = np.maximum.reduceat(sims, start[full])
                    first = np.flatnonzero(sims == np.repeat(top, size[full]))
                    first = first[np.searchsorted(first, start[full])]
                    sim[full], at[full] = top, first - start[full]
                    kid[full] = np.array([f[j][1] for f in found])[code[first]]
                out.append(pa.StructArray.from_arrays(
                    [pa.array(sim), pa.array(-at, pa.int32()), pa.array(kws, pa.string()).take(pa.array(kid))],
                    names=["sim", "npos", "keyword"], mask=pa.array(size == 0)))
            return pa.StructArray.from_arrays(out, names=list(groups))

        kind = ", ".join(f"`{g}`: struct<sim: double, npos: int, keyword: string>" for g in groups)
        return F.arrow_udf(best, f"struct<{kind}>")(F.coalesce(terms, F.array().cast("array<string>")))

    def group_stats(self, sims: Column, group: str) -> Column:
        """struct<avg double, max double> of the similarities to one group."""
        start, n = self.offsets[group]
        return bind(F.slice(sims, start + 1, n), lambda part: F.struct(
            (F.aggregate(part, F.lit(0.0), lambda a, x: a + x) / n).alias("avg"),
            F.array_max(part).alias("max")))


#: Terms whose scores a task remembers.
CACHED_TERMS = 200_000


def _scorer(gram_counts: dict[str, list[int]], norm2: list[int], ranges: list[tuple[int, int]]):
    """Term to ``(sim, kid)`` of the best keyword in each range of the list; ties go to the earlier keyword."""
    held = {g: [(k, n) for k, n in enumerate(c) if n] for g, c in gram_counts.items()}
    known: dict[str, list[tuple[float, int]]] = {}

    def score(term: str) -> list[tuple[float, int]]:
        best = known.get(term)
        if best is None:
            counts = Counter(py_char_grams(term))
            dots: dict[int, int] = {}
            for g, n in counts.items():
                for k, m in held.get(g, ()):
                    dots[k] = dots.get(k, 0) + n * m
            n2 = sum(n * n for n in counts.values())
            sims = {k: d / sqrt(n2 * norm2[k]) for k, d in dots.items()}
            best = []
            for start, size in ranges:
                sim, kid = max(((s, start - k) for k, s in sims.items() if start <= k < start + size), default=(0.0, 0))
                best.append((sim, -kid))
            if len(known) >= CACHED_TERMS:
                known.clear()
            known[term] = best
        return best

    return score


def py_cosine(a: str, b: str) -> float:
    """Reference implementation of the trigram cosine (tests, pandas helpers)."""
    ca, cb = Counter(py_char_grams(a)), Counter(py_char_grams(b))
    dot = sum(v * cb.get(g, 0) for g, v in ca.items())
    if dot == 0:
        return 0.0
    return dot / sqrt(sum(v * v for v in ca.values()) * sum(v * v for v in cb.values()))


def dense_dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def dense_norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def dense_cosine(a: Column, b: Column) -> Column:
    """KEY-4 dense: cosine of two ``array<double>``; a zero norm gives 0."""
    den = dense_norm(a) * dense_norm(b)
    return F.when(den == 0, F.lit(0.0)).otherwise(dense_dot(a, b) / den)


def bind(value: Column, fn) -> Column:
    """Evaluate ``value`` once and hand it to ``fn`` as a lambda variable.

    Referencing an outer expression inside a lambda body re-evaluates it per
    element; binding it first keeps the work linear.
    """
    return F.element_at(F.transform(F.array(value), fn), 1)


def l2_normalise(a: Column) -> Column:
    """Unit vector; a zero vector stays zero."""
    return bind(F.struct(a.cast("array<double>").alias("v"), dense_norm(a).alias("n")),
                lambda s: F.when(s["n"] == 0, s["v"]).otherwise(F.transform(s["v"], lambda x: x / s["n"])))
