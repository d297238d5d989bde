"""Column functions for splitting text: word/punctuation pre-tokenizing,
special-aware encoding tokens and whitespace words for the metrics.

All of them are JVM regex expressions, so they stay inside whole-stage
codegen and never leave the executor JVM.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

# The pre-tokenizer splits text into runs of Unicode word
# characters or runs of characters that are neither word nor whitespace.
# (?U) makes \w and \s Unicode-aware in Java; without it accents split words.
PRE_TOKENIZE_RE = r"(?U)\w+|[^\w\s]+"

# The same split, but a literal special token written in the
# text is one token of its own and never part of a punctuation run.
SPECIAL_ALT = r"\[(?:UNK|PAD|SOS|EOS)\]"
ENCODE_RE = r"(?U)" + SPECIAL_ALT + r"|\w+|(?:(?!" + SPECIAL_ALT + r")[^\w\s])+"

# Characters that separate words for the text metrics, the
# whitespace set of Python's str.split() with no argument.
WHITESPACE_CLASS = (
    r"\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
WORD_RE = "[^" + WHITESPACE_CLASS + "]+"


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def pre_tokenize(text) -> Column:
    """array<string> of word and punctuation tokens, case kept."""
    return F.regexp_extract_all(_col(text), F.lit(PRE_TOKENIZE_RE), 0)


def encode_tokens(text) -> Column:
    """Tokens as the encoder sees them (literal specials kept whole)."""
    return F.regexp_extract_all(_col(text), F.lit(ENCODE_RE), 0)


def whitespace_words(text) -> Column:
    """array<string> of whitespace-separated words (metric tokenization)."""
    return F.regexp_extract_all(F.coalesce(_col(text), F.lit("")), F.lit(WORD_RE), 0)


def ngrams(words, n: int) -> Column:
    """All contiguous n-grams of an array of words, each joined by a space.

    The word array is zipped to every start index instead of being named
    inside the lambda: an outer reference in a lambda is re-evaluated per
    element once Catalyst inlines the producing projection.
    """
    w = _col(words)
    starts = F.sequence(F.lit(1), F.size(w) - n + 1)
    pairs = F.arrays_zip(starts.alias("i"), F.array_repeat(w, F.size(w) - n + 1).alias("w"))
    return F.when(
        F.size(w) >= n,
        F.transform(pairs, lambda p: F.array_join(F.slice(p["w"], p["i"], n), " ")),
    ).otherwise(F.array().cast("array<string>"))
