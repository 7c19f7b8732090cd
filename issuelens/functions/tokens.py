"""Token and array expressions (TOK-*), all JVM-side higher-order functions.

Token lists stay ``array<string>`` inside the row: cleaning, stop-word
removal, tagging with the default lexicon and n-gram generation are narrow
projections, so a preprocessing chain never shuffles.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from issuelens.fixed import ENGLISH_STOPWORDS, PUNCT, default_lexicon
from issuelens.functions.text import WORD_CHARS, WS, WS_CHARS

# TOK-3: a run of word characters (apostrophes included), or one other
# non-blank character. One documented pattern in place of Treebank rules.
TOKEN_PATTERN = "[" + WORD_CHARS + "']+|[^" + WS_CHARS + WORD_CHARS + "']"
PUNCT_TOKEN = r"^\p{P}+$"
NUM_TOKEN = r"^\p{Nd}+$"
SYM_TOKEN = r"^[^\p{L}\p{N}]+$"
ALPHA_TOKEN = r"^\p{L}+$"


def split_words(c: Column) -> Column:
    """TOK-1: whitespace split without empty tokens."""
    return F.filter(F.split(c, WS + "+"), lambda x: x != "")


def tokenize_words(c: Column) -> Column:
    """TOK-3: words and single punctuation characters."""
    return F.regexp_extract_all(c, F.lit(TOKEN_PATTERN), 0)


def ngrams(tokens: Column, n: int = 1) -> Column:
    """TOK-2: contiguous n-grams joined by a space; fewer than n tokens -> []."""
    if n < 1:
        raise ValueError("n must be >= 1")
    if n == 1:
        return tokens
    # the token expression is bound once, then shifted copies are zipped
    def build(t: Column) -> Column:
        m = F.greatest(F.size(t) - n + 1, F.lit(0))
        grams = F.slice(t, 1, m)
        for k in range(1, n):
            grams = F.zip_with(grams, F.slice(t, k + 1, m), lambda a, b: F.concat(a, F.lit(" "), b))
        return F.when(F.size(t) >= n, grams).otherwise(F.array().cast("array<string>"))
    return F.element_at(F.transform(F.array(tokens), build), 1)


def drop_punct_tokens(tokens: Column) -> Column:
    """TOK-4: drop a token that is empty or a substring of the punctuation string."""
    return F.filter(tokens, lambda t: ~F.lit(PUNCT).contains(t))


def drop_punct_chars(tokens: Column) -> Column:
    """Drop tokens made only of Unicode punctuation (a tagger's ``is_punct``)."""
    return F.filter(tokens, lambda t: ~t.rlike(PUNCT_TOKEN))


def stop_list(base: Iterable[str] = ENGLISH_STOPWORDS, extra: Iterable[str] = (),
              keep: Iterable[str] = ()) -> list[str]:
    """TOK-12 + TOK-6: union of the stop sets minus the whitelist, sorted."""
    keep = set(keep)
    return sorted((set(base) | set(extra)) - keep)


def remove_stopwords(tokens: Column, stopwords: Iterable[str], case_insensitive: bool = False) -> Column:
    """TOK-5: multiplicity kept; ``In`` over a literal list plans as a hash set."""
    words = list(stopwords)
    if case_insensitive:
        return F.filter(tokens, lambda t: ~F.lower(t).isin(words))
    return F.filter(tokens, lambda t: ~t.isin(words))


def keep_alpha(tokens: Column) -> Column:
    """TOK-7: alphabetic tokens only."""
    return F.filter(tokens, lambda t: t.rlike(ALPHA_TOKEN))


def is_repetitive(phrase: Column) -> Column:
    """TOK-14: all tokens equal after removing double quotes; empty -> false."""
    toks = split_words(F.regexp_replace(phrase, '"', ""))
    return F.coalesce(F.size(F.array_distinct(toks)) == 1, F.lit(False))


def map_pos_tag(tag: Column) -> Column:
    """TOK-10: Penn tag -> WordNet class by first letter; anything else -> noun."""
    first = F.substring(tag, 1, 1)
    return (F.when(first == "J", "a").when(first == "V", "v")
            .when(first == "N", "n").when(first == "R", "r").otherwise("n"))


def rule_pos(t: Column) -> Column:
    """Part of speech of a token missing from the lexicon."""
    return F.when(t.rlike(NUM_TOKEN), "NUM").when(t.rlike(SYM_TOKEN), "SYM").otherwise("NOUN")


def tag_tokens(tokens: Column, lexicon: list[tuple[str, str, str]] | None = None) -> Column:
    """TOK-8/TOK-9 in-row: ``array<struct<tok,pos,lemma>>`` from a bounded lexicon.

    The lexicon is a literal list, so the lookup is an expression inside the
    projection, not a join. Spark scans a map's keys one by one, but plans
    ``isin`` over literals as a hash set: tokens that the lexicon lacks (nearly
    all) never reach the map, which has one value with both fields. A lexicon
    *table* goes through ``operators.lexicon.tag_tokens_table`` instead.
    """
    rows = list(lexicon if lexicon is not None else default_lexicon())
    if not rows:
        return F.transform(tokens, lambda t: F.struct(t.alias("tok"), rule_pos(t).alias("pos"), t.alias("lemma")))
    known = sorted({t for t, _, _ in rows})
    entries = F.create_map(*[x for t, p, l in dict((r[0], r) for r in rows).values() for x in (
        F.lit(t), F.struct(F.lit(t).alias("tok"), F.lit(p).alias("pos"), F.lit(l).alias("lemma")))])
    return F.transform(tokens, lambda t: F.when(t.isin(known), F.element_at(entries, t)).otherwise(
        F.struct(t.alias("tok"), rule_pos(t).alias("pos"), t.alias("lemma"))))


def kept_lemmas(tokens: Column, keep: Iterable[str] | None = None, lexicon: list[tuple[str, str, str]] | None = None) -> Column:
    """``lemmas(filter_pos(tag_tokens(tokens, lexicon), keep))`` without a struct for each token (all tokens if ``keep`` is None).

    A token that the lexicon lacks is its own lemma and a number, a symbol or a
    noun, so one pattern decides whether it stays.
    """
    rows = {r[0]: r for r in (lexicon if lexicon is not None else default_lexicon())}
    if keep is not None:
        keep = set(keep)
        out = [p[1:-1] for pos, p in (("NUM", NUM_TOKEN), ("SYM", SYM_TOKEN)) if (pos in keep) != ("NOUN" in keep)]
        pattern = f"^(?:{'|'.join(out)})$"
        known, kept = sorted(rows), sorted(t for t, p, _ in rows.values() if p in keep)

        def stays(t: Column) -> Column:
            ruled = F.lit("NOUN" in keep) if not out else ~t.rlike(pattern) if "NOUN" in keep else t.rlike(pattern)
            return F.when(t.isin(known), t.isin(kept)).otherwise(ruled) if known else ruled
        tokens = F.filter(tokens, stays)
    changed = {t: l for t, _, l in rows.values() if l != t}
    if not changed:
        return tokens
    entries = F.create_map(*[x for t, l in changed.items() for x in (F.lit(t), F.lit(l).cast("string"))])
    return F.transform(tokens, lambda t: F.when(t.isin(sorted(changed)), F.element_at(entries, t)).otherwise(t))


def filter_pos(tagged: Column, keep: Iterable[str]) -> Column:
    """TOK-8: keep tagged tokens whose part of speech is in ``keep``."""
    keep = list(keep)
    return F.filter(tagged, lambda x: x["pos"].isin(keep))


def lemmas(tagged: Column) -> Column:
    """TOK-9: the lemma field of tagged tokens."""
    return F.transform(tagged, lambda x: x["lemma"])


def rejoin_tokens(tokens: Column) -> Column:
    """TOK-11: order and multiplicity kept."""
    return F.array_join(tokens, " ")
