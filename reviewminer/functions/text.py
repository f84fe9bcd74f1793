"""Tokenising as column expressions, evaluated inside one review row."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .wordlists import STOPWORDS

# Clitics, runs of letters and digits, or any other visible character. Words come
# early and ASCII is listed first because almost every token is such a word.
TOKEN_PATTERN = r"n't|[a-z0-9\p{L}\p{N}]+|'(?:s|m|d|re|ve|ll)|[^\s]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times in ``body``.

    A plain nested expression would be inlined into every lambda that uses it
    and evaluated per element; a lambda variable is evaluated once per row.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def tokens(text: Column) -> Column:
    """Lower-case, split clitics off, return ``array<string>``.

    The rare word is looked for bytewise before the regular expression runs.
    """
    split_clitics = F.replace(F.lower(text), F.lit("n't"), F.lit(" n't"))
    two_words = F.regexp_replace(split_clitics, r"\bcannot\b", "can not")
    prepared = F.when(F.contains(split_clitics, F.lit("cannot")), two_words).otherwise(split_clitics)
    return F.regexp_extract_all(prepared, F.lit(TOKEN_PATTERN), F.lit(0))


def is_content(word: Column, stopwords: Iterable[str] = STOPWORDS) -> Column:
    """True unless ``word`` is a stop word; every copy is dropped."""
    stop = list(stopwords)
    return ~word.isin(stop) if stop else F.lit(True)


def content_words(text: Column, stopwords: Iterable[str] = STOPWORDS) -> Column:
    """Tokens of a text without stop words, order and copies kept."""
    stop = tuple(stopwords)
    return F.filter(tokens(text), lambda w: is_content(w, stop))


def whitespace_words(text: Column) -> Column:
    """Blank-separated lower-case words; trailing blanks leave no empty word."""
    return F.split(F.rtrim(F.lower(text)), " ")
