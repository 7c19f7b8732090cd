"""KEY-9 / JOIN-4 against a keyword *table*: a similarity join by a segment index.

Two strings are alike when ``round(100 * 2 * LCS / (la + lb)) > cutoff``, that
is when their indel distance (insertions and deletions) is at most
``k = floor((199 - 2 * cutoff) * (la + lb) / 200)``. Hence

* lengths: for each length of a term only a few lengths of a keyword can match;
* segments (pigeonhole): if a keyword is cut into ``k + 1`` segments, each edit
  spoils one at most, so a matching term holds one of them unchanged, at a
  place that the edits left and right of it allow;
* letters: a letter that only one of the two has costs an edit.

Keywords are indexed by (both lengths, segment number, segment), terms are
probed with their substrings of these lengths and places: an equi-join whose
plan does not depend on the number of keywords. The letters are compared inside
the join, and what is left is verified by a bit-parallel LCS over the shorter
string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from issuelens import fixed
from issuelens.functions.vectors import bind
from issuelens.session import written

#: Bits of the recurrence; pairs of longer strings are compared by the table of the recurrence.
WORD_BITS = 62
#: A segment index needs more letters than edits, so a higher ratio than this.
LEAST_CUTOFF = 67


def letters(term: Column) -> Column:
    return F.filter(F.split(term, ""), lambda c: c != "")


def letter_set(term: Column) -> Column:
    """A bit for each letter that is there (letters may share one of 63)."""
    return F.aggregate(F.array_distinct(letters(term)), F.lit(0).cast("long"),
                       lambda v, c: v.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(c), F.lit(63)).cast("int"))))


def lcs_bits(term: Column, keyword: Column) -> Column:
    """LCS length of two columns, ``keyword`` of at most ``WORD_BITS`` letters.

    Over the letters of ``term``: ``u = v & m; v = ((v + u) | (v - u)) & full``
    where ``m`` marks the places of the letter in the keyword; the zero bits
    left of ``full`` count.
    """
    def places(ks: Column, c: Column) -> Column:
        return F.aggregate(F.transform(ks, lambda x, j: F.when(x == c, F.call_function("shiftleft", F.lit(1).cast("long"), j))
                                       .otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, x: s + x)

    def scan(s: Column) -> Column:
        def step(v: Column, m: Column) -> Column:
            u = v.bitwiseAND(m)
            return (v + u).bitwiseOR(v - u).bitwiseAND(s["full"])
        marks = F.transform(s["t"], lambda c: places(s["k"], c))
        return F.length(keyword) - F.bit_count(F.aggregate(marks, s["full"], step))

    full = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(keyword)) - 1
    return bind(F.struct(letters(term).alias("t"), letters(keyword).alias("k"), full.alias("full")), scan)


def lcs_table(term: Column, keyword: Column) -> Column:
    """LCS length of two columns of any length, one row of the table for each letter of ``term``."""
    def step(ks: Column, row: Column, c: Column) -> Column:
        before = F.concat(F.array(F.lit(0)), F.slice(row, 1, F.size(row) - 1))
        took = F.zip_with(F.zip_with(ks, before, lambda k, p: F.when(k == c, p + 1).otherwise(F.lit(0))), row, lambda a, b: F.greatest(a, b))
        return F.aggregate(took, F.array().cast("array<int>"), lambda acc, x: F.concat(acc, F.array(F.greatest(
            x, F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0))))))
    last = bind(letters(keyword), lambda ks: F.aggregate(letters(term), F.transform(ks, lambda _: F.lit(0)), lambda row, c: step(ks, row, c)))
    return F.element_at(last, -1)


def alike(term: Column, keyword: Column, cutoff: int = fixed.FUZZ_CUTOFF) -> Column:
    """The decision in integers: ``400 * LCS >= (2 * cutoff + 1) * (la + lb)``."""
    la, lb = F.length(term), F.length(keyword)
    lcs = (F.when(lb <= WORD_BITS, lcs_bits(term, keyword)).when(la <= WORD_BITS, lcs_bits(keyword, term))
           .otherwise(lcs_table(term, keyword)))
    return 400 * lcs >= (2 * cutoff + 1) * (la + lb)


def fuzzy_pairs(terms: DataFrame, keywords: DataFrame, term_col: str = "phrase", keyword_col: str = "keyword",
                cutoff: int = fixed.FUZZ_CUTOFF) -> DataFrame:
    """``(term, keyword)``: every distinct term with every distinct keyword that it is alike.

    Nulls and empty strings are like nothing. Pairs of strings that are both
    longer than ``WORD_BITS`` letters (no words) meet by length alone.
    """
    if cutoff < LEAST_CUTOFF:
        raise ValueError(f"the segment index needs a cutoff of {LEAST_CUTOFF} or more, not {cutoff}")
    slack = 199 - 2 * cutoff
    longest = WORD_BITS * (200 + slack) // (200 - slack)

    def edits(la: Column, lb: Column) -> Column:
        return F.floor((la + lb) * slack / 200).cast("int")

    def other_lengths(n: Column) -> Column:
        """The lengths that a string alike can have; none if both are long."""
        least = F.ceil(n * (200 - slack) / (200 + slack)).cast("int")
        most = F.floor(n * (200 + slack) / (200 - slack)).cast("int")
        most = F.least(most, F.when(n > WORD_BITS, WORD_BITS).otherwise(longest))
        return F.explode(F.when(least <= most, F.sequence(least, most)).otherwise(F.array().cast("array<int>")))

    def strings(table: DataFrame, column: str, name: str) -> DataFrame:
        rows = table.select(F.col(column).cast("string").alias(name)).where(F.length(name) > 0).distinct()
        return rows.withColumns({f"n_{name}": F.length(name), f"set_{name}": letter_set(F.col(name))})

    def segments(rows: DataFrame) -> DataFrame:
        """Both lengths known: a row for each segment, with its start and size in the keyword."""
        rows = rows.withColumn("k", edits(F.col("n_term"), F.col("n_keyword"))).withColumn("segment", F.explode(F.sequence(F.lit(0), F.col("k"))))
        start = F.floor(F.col("segment") * F.col("n_keyword") / (F.col("k") + 1)).cast("int")
        end = F.floor((F.col("segment") + 1) * F.col("n_keyword") / (F.col("k") + 1)).cast("int")
        return rows.withColumns({"start": start, "letters": end - start})

    left, right = strings(terms, term_col, "term"), strings(keywords, keyword_col, "keyword")
    index = segments(right.where(F.col("n_keyword") <= longest).withColumn("n_term", other_lengths(F.col("n_keyword"))))
    index = index.withColumn("part", F.substring("keyword", F.col("start") + 1, F.col("letters"))).drop("k", "start", "letters")
    probes = segments(left.where(F.col("n_term") <= longest).withColumn("n_keyword", other_lengths(F.col("n_term"))))
    # The edits left of the segment move it, and those right of it make up for the rest.
    apart = F.col("n_term") - F.col("n_keyword")
    least = F.greatest(F.lit(0), F.col("start") + F.ceil((apart - F.col("k")) / 2).cast("int"))
    most = F.least(F.col("n_term") - F.col("letters"), F.col("start") + F.floor((apart + F.col("k")) / 2).cast("int"))
    probes = probes.withColumns({"least": least, "most": most}).where("least <= most").withColumn("at", F.explode(F.sequence("least", "most")))
    probes = probes.withColumn("part", F.substring("term", F.col("at") + 1, F.col("letters")))
    probes = probes.select("term", "set_term", "n_term", "n_keyword", "segment", "part", "k")
    few = F.bit_count(F.col("set_term").bitwiseXOR(F.col("set_keyword"))) <= F.col("k")
    keys = ["n_term", "n_keyword", "segment", "part"]
    pairs = probes.join(index, keys).where(few).select("term", "keyword").distinct()

    def steps(n: str) -> Column:
        return F.floor(F.log(F.col(n)) / F.log(F.lit((200 + slack) / (200 - slack)))).cast("int")

    long_terms = left.where(F.col("n_term") > WORD_BITS).withColumn("step", F.explode(F.sequence(steps("n_term") - 1, steps("n_term") + 1)))
    long_pairs = (long_terms.join(right.where(F.col("n_keyword") > WORD_BITS).withColumn("step", steps("n_keyword")), "step")
                  .withColumn("k", edits(F.col("n_term"), F.col("n_keyword")))
                  .where(few & (F.abs(F.col("n_term") - F.col("n_keyword")) <= F.col("k"))).select("term", "keyword"))
    return pairs.unionByName(long_pairs).where(alike(F.col("term"), F.col("keyword"), cutoff))


def fuzzy_anti_join(rows: DataFrame, keywords: DataFrame, term_col: str = "phrase", keyword_col: str = "keyword",
                    cutoff: int = fixed.FUZZ_CUTOFF) -> DataFrame:
    """KEY-9 / JOIN-4: the ``rows`` whose term is like no keyword of the table (a null term is like none)."""
    rows = written(rows, "fuzzy-rows")  # read three times below; what makes the terms may be long
    near = fuzzy_pairs(rows, keywords, term_col, keyword_col, cutoff).select(F.col("term").alias(term_col)).distinct()
    return rows.join(near, term_col, "left_anti").select(rows.columns)
