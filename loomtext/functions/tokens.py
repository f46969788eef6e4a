"""Tokenizers of evaluation, as column expressions from text to an array of tokens."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .normalize import replaced

# The rules of the mteval 13a tokenizer.
RULES_13A = [
    (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", " $1 "), (r"([^0-9])([\.,])", "$1 $2 "), (r"([\.,])([^0-9])", " $1 $2"), (r"([0-9])(-)", "$1 $2 "),
]
ENTITIES = [("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")]
RULES_INTL = [(r"([^\p{Nd}])(\p{P})", "$1 $2 "), (r"(\p{P})([^\p{Nd}])", " $1 $2"), (r"(\p{S})", " $1 ")]
SPACE_SIGN = "▁"


def _unescaped(text: Column) -> Column:
    for a, b in ENTITIES:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def _plain(text: Column) -> Column:
    text = F.replace(text, F.lit("<skipped>"), F.lit(""))
    return F.replace(F.replace(text, F.lit("-\n"), F.lit("")), F.lit("\n"), F.lit(" "))


def tokenize_13a(text: Column) -> Column:
    padded = F.concat(F.lit(" "), _unescaped(_plain(text)), F.lit(" "))
    return F.trim(F.regexp_replace(replaced(padded, RULES_13A), r"(?U)\s+", " "))


def tokenize_intl(text: Column) -> Column:
    return F.trim(F.regexp_replace(replaced(_unescaped(_plain(text)), RULES_INTL), r"(?U)\s+", " "))


def tokenize_zh(text: Column) -> Column:
    """Chinese characters apart, the rest by 13a."""
    apart = F.regexp_replace(text, r"([\p{IsHan}　-〿＀-￯])", " $1 ")
    return tokenize_13a(apart)


TOKENIZERS: dict[str, Callable[[Column], Column]] = {"none": lambda c: c, "13a": tokenize_13a, "intl": tokenize_intl, "zh": tokenize_zh}


def tokenized(text: Column, kind: str = "13a", lowercase: bool = False, without_punctuation: bool = False, characters: bool = False) -> Column:
    """The tokenized text: by ``kind``, then without tokens of punctuation alone, then by character, then in lower case."""
    if kind not in TOKENIZERS:
        raise ValueError(f"unknown tokenizer {kind!r}; there are {sorted(TOKENIZERS)}")
    out = TOKENIZERS[kind](text)
    if without_punctuation:
        out = F.array_join(F.filter(F.split(out, " "), lambda t: ~t.rlike(r"^\p{P}*$")), " ")
    if characters:
        out = F.array_join(F.filter(F.split(F.replace(out, F.lit(" "), F.lit(SPACE_SIGN)), ""), lambda c: c != ""), " ")
    return F.lower(out) if lowercase else out


def words(text: Column) -> Column:
    """What stands between white space; of an empty text nothing."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def scoring_tokens(text: Column) -> Column:
    """Tokens that word error rates compare: 13a, lower case, no punctuation."""
    return words(tokenized(text, "13a", lowercase=True, without_punctuation=True))
