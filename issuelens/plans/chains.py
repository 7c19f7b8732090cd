"""The four preprocessing chains, as ``Column -> array<string>`` expressions.

Order matters and differs between chains; each class states its order. A chain
is the tokens *before* tagging, the parts of speech and the surface forms that
stay, and the tokens made of the lemmas *after* it. With a literal lexicon (or
none) tagging is an expression too and the chain is a narrow projection that
tests the surface form first and never builds tagged tokens;
``with_lexicon_table`` tags by a join instead.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from issuelens import fixed
from issuelens.functions import text as T
from issuelens.functions import tokens as K


@dataclass(frozen=True)
class Chain:
    before: Callable[[Column], Column]
    after: Callable[[Column], Column] = lambda lemmas: lemmas
    keep: tuple[str, ...] | None = None
    surface: Callable[[Column], Column] | None = None

    def __call__(self, text: Column, lexicon=None) -> Column:
        tokens = self.before(text)
        if self.surface:
            tokens = F.filter(tokens, self.surface)
        return self.after(K.kept_lemmas(tokens, self.keep, lexicon))

    def with_lexicon_table(self, df: DataFrame, text: Column, lexicon: DataFrame, out: str = "tokens") -> DataFrame:
        """``df`` with the chain's tokens, by a lexicon table ``(token, lex_pos, lex_lemma)`` of any size."""
        from issuelens.operators.lexicon import tag_tokens_table
        tagged = tag_tokens_table(df.withColumn("_toks", self.before(text)), "_toks", lexicon, "_tagged")
        kept = F.col("_tagged") if self.keep is None else K.filter_pos(F.col("_tagged"), self.keep)
        if self.surface:
            kept = F.filter(kept, lambda x: self.surface(x["tok"]))
        return tagged.withColumn(out, self.after(K.lemmas(kept))).drop("_toks", "_tagged")


def labelling_chain(excluded=()) -> Chain:
    """``preprocess_labelling``: CLN-14 -> tokenise -> stop words on the surface
    form (``move`` whitelisted) -> drop punctuation -> POS in the six kept
    tags -> lemma -> TOK-4 on the lemma (and the excluded words)."""
    excluded = list(excluded)

    def before(text: Column) -> Column:
        toks = K.tokenize_words(T.clean_labelling(text))
        return K.drop_punct_chars(K.remove_stopwords(toks, K.stop_list(keep=fixed.STOPWORD_WHITELIST)))

    def after(lemmas: Column) -> Column:
        lem = F.transform(lemmas, lambda t: F.trim(t))
        if excluded:
            lem = F.filter(lem, lambda t: ~t.isin(excluded))
        return K.drop_punct_tokens(lem)

    return Chain(before, after, tuple(fixed.POS_LABELLING))


def labelling_tokens(text: Column, lexicon=None, excluded=()) -> Column:
    return labelling_chain(excluded)(text, lexicon)


#: ``preprocess_seed``: lower -> tokenise -> custom stop words -> POS in {NOUN, VERB, ADJ} -> English stop words ->
#: alphabetic -> lemma.
SEED_CHAIN = Chain(lambda text: K.remove_stopwords(K.tokenize_words(T.lowercase(text)), fixed.SEED_STOPWORDS), keep=tuple(fixed.POS_SEED),
                   surface=lambda t: ~t.isin(fixed.ENGLISH_STOPWORDS) & t.rlike(K.ALPHA_TOKEN))


def seed_tokens(text: Column, lexicon=None) -> Column:
    return SEED_CHAIN(text, lexicon)


def mmr_stopwords() -> list[str]:
    return K.stop_list(extra=fixed.MMR_STOPWORDS)


#: ``preprocess_keybert``: null -> 'nan', lower -> tokenise -> TOK-4 -> lemma -> stop words on the lower-cased lemma
#: (English + additional).
KEYBERT_CHAIN = Chain(lambda text: K.drop_punct_tokens(K.tokenize_words(T.lowercase(T.null_text(text, "nan")))),
                      lambda lemmas: K.remove_stopwords(lemmas, mmr_stopwords(), case_insensitive=True))


def keybert_tokens(text: Column, lexicon=None) -> Column:
    return KEYBERT_CHAIN(text, lexicon)


def tfidf_chain(is_english: Column) -> Chain:
    """``preprocess_tfidf``: null -> 'nan' -> language gate (non-English -> no
    tokens) -> CLN-16 -> tokenise -> stop words (English + project names) on
    the surface form -> lemma. FLT-2 (drop empty) is applied by the caller."""
    def before(text: Column) -> Column:
        toks = K.tokenize_words(T.clean_ascii(T.null_text(text, "nan")))
        toks = K.remove_stopwords(toks, K.stop_list(extra=fixed.TFIDF_PROJECT_STOPWORDS))
        return F.when(F.coalesce(is_english, F.lit(False)), toks).otherwise(F.array().cast("array<string>"))

    return Chain(before)


def tfidf_tokens(text: Column, is_english: Column, lexicon=None) -> Column:
    return tfidf_chain(is_english)(text, lexicon)
