"""Text-cleaning expressions (CLN-*): each is a pure ``Column -> Column``.

Patterns are written with explicit Unicode classes instead of ``\\s``/``\\w``/
``\\d`` so that they mean the same thing in Java regex (Spark) and in RE2
(the DuckDB oracle), and match what Python's ``re`` does on ``str``. Java's
``(?U)`` flag is avoided on purpose: in RE2 it means "ungreedy".
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from issuelens.fixed import PUNCT

# Characters Python's str.isspace() accepts (the Unicode White_Space set plus
# the ASCII information separators).
WS_CHARS = (
    r"\t\n\x0B\f\r \x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
WS = "[" + WS_CHARS + "]"
WORD_CHARS = r"\p{L}\p{N}_"

# CLN-1: a word of at least two capitalised humps. Spark gets Python's Unicode
# word boundary through look-around; RE2 has none, so the oracle uses \b
# (identical on ASCII text, and the test tables hold no CamelCase at all).
CAMEL = r"(?<![" + WORD_CHARS + r"])[A-Z][a-z]+(?:[A-Z][a-z]+)+(?![" + WORD_CHARS + r"])"
CAMEL_RE2 = r"\b[A-Z][a-z]+(?:[A-Z][a-z]+)+\b"
URL = r"https?://[^" + WS_CHARS + r"]+"
FENCED = r"(?s)```.*?```"
INLINE = r"`[^`]*`"
JIRA_CODE = r"(?s)\{code(:[a-z]+)?\}.*?\{code\}"
JIRA_CODE_STRICT = r"(?s)\{code(:[^}]*)?\}.*?\{code\}"
JIRA_NOFORMAT = r"(?s)\{noformat\}.*?\{noformat\}"
JIRA_COLOR = r"\{color:[^}]+\}"
NEWLINES = r"\n+"
NON_ASCII = r"[^\x00-\x7f]"
DIGITS = r"\p{Nd}+"


def strip_camel_case(c: Column) -> Column:
    """CLN-1: delete CamelCase words (two humps or more); run before lower()."""
    return F.regexp_replace(c, CAMEL, "")


def strip_urls(c: Column, replacement: str = "") -> Column:
    """CLN-2: ``http(s)://`` up to the next blank, replaced by ``replacement``."""
    return F.regexp_replace(c, URL, replacement)


def strip_fenced_code(c: Column) -> Column:
    """CLN-3: triple-backtick blocks, lazy, across lines."""
    return F.regexp_replace(c, FENCED, "")


def strip_inline_code(c: Column) -> Column:
    """CLN-4: single-backtick spans (may cross lines); run after CLN-3."""
    return F.regexp_replace(c, INLINE, "")


def lowercase(c: Column) -> Column:
    """CLN-5."""
    return F.lower(c)


def strip_jira_code(c: Column, strict_openers: bool = False) -> Column:
    """CLN-6: ``{code}`` blocks -> one blank.

    The default opener pattern only accepts ``{code:lang}``; an opener such as
    ``{code:title=A.java}`` does not match, so its closer pairs with the next
    ``{code}`` and the prose between them goes. ``strict_openers=True``
    accepts any opener.
    """
    return F.regexp_replace(c, JIRA_CODE_STRICT if strict_openers else JIRA_CODE, " ")


def strip_jira_noformat(c: Column) -> Column:
    """CLN-7."""
    return F.regexp_replace(c, JIRA_NOFORMAT, " ")


def strip_jira_color(c: Column) -> Column:
    """CLN-8: opening ``{color:...}`` tags only; the closing ``{color}`` stays."""
    return F.regexp_replace(c, JIRA_COLOR, "")


def collapse_newlines(c: Column) -> Column:
    """CLN-9."""
    return F.regexp_replace(c, NEWLINES, " ")


def collapse_whitespace(c: Column) -> Column:
    """CLN-10: runs of any Unicode blank -> one space, then strip.

    After the collapse every blank is a single U+0020, so ``trim`` (which
    strips spaces) is a full Unicode strip.
    """
    return F.trim(F.regexp_replace(c, WS + "+", " "))


def strip_non_ascii(c: Column) -> Column:
    """CLN-11."""
    return F.regexp_replace(c, NON_ASCII, "")


def strip_digits(c: Column) -> Column:
    """CLN-12: any Unicode decimal digit run."""
    return F.regexp_replace(c, DIGITS, "")


def strip_punctuation(c: Column) -> Column:
    """CLN-13: delete (not blank) the 32 ASCII punctuation characters."""
    return F.translate(c, PUNCT, "")


def clean_labelling(c: Column) -> Column:
    """CLN-14: camel -> url('') -> fenced -> inline -> lower."""
    return lowercase(strip_inline_code(strip_fenced_code(strip_urls(strip_camel_case(c), ""))))


def clean_jira(c: Column, strict_openers: bool = False) -> Column:
    """CLN-15: lower -> {code} -> {noformat} -> {color:} -> url(' ') -> newlines -> blanks."""
    c = lowercase(c)
    c = strip_jira_code(c, strict_openers)
    c = strip_jira_noformat(c)
    c = strip_jira_color(c)
    c = strip_urls(c, " ")
    c = collapse_newlines(c)
    return collapse_whitespace(c)


def clean_ascii(c: Column) -> Column:
    """CLN-16: lower -> non-ASCII -> digits -> punctuation."""
    return strip_punctuation(strip_digits(strip_non_ascii(lowercase(c))))


# Fixed values (CLN-17): opt-in line rules that the labelled-data cleaner keeps switched off.
# Each is (name, Java regex, replacement); applied in this order.
OPTIONAL_LINE_RULES = [
    ("plan_lines", r"(?m)^[ \t]*(plan after changes looks like|and before changes:|query plan examples:).*$", ""),
    ("upgrade_lines", r"(?m)^[\w.\-]+:[\w.\-]+[ .]*\d+(\.\d+)*\s*->\s*\d+(\.\d+)*$", " "),
    ("bare_upgrade_lines", r"(?m)^\s*[\w.\-]+[ .]*\d+(\.\d+)*\s*->\s*\d+(\.\d+)*$", " "),
    ("info_lines", r"(?m)^\[info\].*$", " "),
    ("diff_blocks", r"diff --git[\s\S]*?(?=(?:\n[^+\-@\s])|$)", " "),
    ("diff_word_lines", r"(?m)^.*diff.*$", ""),
    ("patch_from_lines", r"(?m)^<.*---.*$", ""),
    ("patch_to_lines", r"(?m)^>.*$", ""),
    ("patch_change_lines", r"(?m)^\d+c\d+$", ""),
    ("patch_lines", r"(?m)^(---|\+\+\+|@@|\+|-).*$\n?", " "),
    ("double_brace", r"(?s)\{\{.*?\}\}", " "),
    ("java_import_block", r"(?ms)import .+?^\}", " "),
    ("indented_code", r"(?:\n|^)(    |\t).*(?:\n|$)", "\n"),
    ("java_package_block", r"(?ms)package [\s\S]+?^\}", ""),
    ("drill_physical_tail", r"(?i)drill physical[\s\S]*", ""),
    ("non_ascii_blank", r"[^\x00-\x7F]+", " "),
]


def optional_line_rules(c: Column, names: list[str] | None = None) -> Column:
    """CLN-17: fold the chosen rules (all by default) into one Column."""
    rules = [r for r in OPTIONAL_LINE_RULES if names is None or r[0] in names]
    return reduce(lambda acc, r: F.regexp_replace(acc, r[1], r[2]), rules, c)


def null_text(c: Column, policy: str = "empty") -> Column:
    """PRJ-3: null -> ``""`` (``empty``) or the word ``nan`` (``nan``)."""
    if policy not in ("empty", "nan"):
        raise ValueError(f"unknown null policy {policy!r}")
    return F.coalesce(c, F.lit("" if policy == "empty" else "nan"))


def combine_text(summary: Column, description: Column, sep: str = " - ") -> Column:
    """PRJ-1: ``coalesce(S,'') || sep || coalesce(D,'')``; both empty keeps ``sep``."""
    return F.concat(F.coalesce(summary, F.lit("")), F.lit(sep), F.coalesce(description, F.lit("")))


# Fixed value (CLN-18): a code-looking line (after stripping blanks).
CODE_LINE = r"^(import |package |public |private |protected |class |@|/|\*|\{|\}|;)"


def drop_code_runs(c: Column) -> Column:
    """CLN-18: drop runs of >= 2 consecutive code-looking lines, keep single ones.

    A code line belongs to a run of two or more exactly when one of its
    neighbours is a code line too, so the rule is decided inside the row from
    each line's neighbour flags (no explode, no regroup). Kept lines are
    stripped, blank ones dropped, and the rest joined by one space.
    """
    lines = F.transform(F.split(c, "\n"), lambda l: F.trim(F.regexp_replace(l, "^" + WS + "+|" + WS + "+$", "")))
    flags = F.transform(lines, lambda l: l.rlike(CODE_LINE))
    n = F.size(flags)
    prev = F.concat(F.array(F.lit(False)), F.slice(flags, 1, F.greatest(n - 1, F.lit(0))))
    nxt = F.concat(F.slice(flags, 2, F.greatest(n - 1, F.lit(0))), F.array(F.lit(False)))
    z = F.arrays_zip(lines.alias("l"), flags.alias("f"), prev.alias("p"), nxt.alias("n"))
    kept = F.filter(z, lambda r: ~(r["f"] & (r["p"] | r["n"])) & (r["l"] != ""))
    return collapse_whitespace(F.array_join(F.transform(kept, lambda r: r["l"]), " "))


def apply_text_fn(c: Column, fn) -> Column:
    """UDF-1: a caller-supplied ``pandas.Series -> pandas.Series`` text function,
    run as an Arrow-batched pandas UDF (the open extension point; prefer a
    native Column expression when one exists)."""
    import pandas as pd  # noqa: F401
    from pyspark.sql.functions import pandas_udf
    return pandas_udf(fn, "string")(c)
