"""Spoken numbers read word by word in Python: what the column version is held against."""

import re
from fractions import Fraction

from loomtext.functions.numbers import CENTS, DECIMALS, HALF_AFTER, LEXICON, SPACED

_NUMERIC = re.compile(r"\d+(\.\d+)?\Z")
_SIGNED = frozenset("-+£€$¢")
_HALVES = re.compile(r"(\S+)?\s*(?:\band\s+a\s+half\b\s*)+")


def _kind(word: str | None) -> str:
    return LEXICON[word][0] if word in LEXICON else ""


class Reading:
    """One pass over the words of a text."""

    def __init__(self, words: list[str]):
        self.words = words
        self.amount: int | str | None = None
        self.sign = ""
        self.out: list[str] = []
        self.skip = False

    def emit(self, what: object) -> None:
        self.out.append(f"{self.sign}{what}")
        self.sign, self.amount = "", None

    def flush(self) -> None:
        if self.amount is not None:
            self.emit(self.amount)

    def digits(self, more: object) -> str:
        return f"{self.amount or ''}{more}"

    def run(self) -> list[str]:
        edge = [None, *self.words, None]
        for k, word in enumerate(self.words):
            if self.skip:
                self.skip = False
                continue
            before, after = edge[k], edge[k + 2]
            signed = word[0] in _SIGNED
            bare = word[1:] if signed else word
            if _NUMERIC.match(bare):
                self.arabic(word, bare, signed)
            elif word in LEXICON:
                kind, value, ending = LEXICON[word]
                getattr(self, f"on_{kind}")(word, value, ending, before, after)
            else:
                self.flush()
                self.emit(word)
        self.flush()
        return self.out

    def arabic(self, word: str, bare: str, signed: bool) -> None:
        if isinstance(self.amount, str) and self.amount.endswith("."):
            self.amount += word
            return
        self.flush()
        self.sign = word[0] if signed else self.sign
        exact = Fraction(bare)
        self.amount = exact.numerator if exact.denominator == 1 else bare

    def on_zero(self, word, value, ending, before, after):
        self.amount = self.digits("0")

    def with_unit(self, n: int, before: str | None) -> int | str:
        have = self.amount
        if have is None:
            return n
        if isinstance(have, str) or _kind(before) == "unit":
            return f"{have[:-1]}{n}" if _kind(before) == "ten" and n < 10 else f"{have}{n}"
        room = 10 if n < 10 else 100
        return have + n if have % room == 0 else f"{have}{n}"

    def with_ten(self, n: int) -> int | str:
        have = self.amount
        if have is None:
            return n
        return have + n if isinstance(have, int) and have % 100 == 0 else f"{have}{n}"

    def times(self, n: int) -> int | None:
        """The pending amount times n, of a whole number its last three digits; None if that isn't whole."""
        have = self.amount
        if isinstance(have, int) and have:
            return have // 1000 * 1000 + have % 1000 * n
        try:
            product = Fraction(have) * n
        except ValueError:
            return None
        return product.numerator if product.denominator == 1 else None

    def on_unit(self, word, value, ending, before, after):
        self.amount = self.with_unit(value, before)

    def on_unit_end(self, word, value, ending, before, after):
        self.emit(f"{self.with_unit(value, before)}{ending}")

    def on_ten(self, word, value, ending, before, after):
        self.amount = self.with_ten(value)

    def on_ten_end(self, word, value, ending, before, after):
        self.emit(f"{self.with_ten(value)}{ending}")

    def on_power(self, word, value, ending, before, after):
        product = value if self.amount is None else self.times(value)
        if product is None:
            self.flush()
            product = value
        self.amount = product

    def on_power_end(self, word, value, ending, before, after):
        product = value if self.amount is None else self.times(value)
        if product is None:
            self.flush()
            product = value
        self.emit(f"{product}{ending}")

    def on_sign(self, word, value, ending, before, after):
        self.flush()
        if self.goes_on(after):
            self.sign = value
        else:
            self.emit(word)

    def on_currency(self, word, value, ending, before, after):
        if self.amount is None:
            self.emit(word)
        else:
            self.sign = value
            self.flush()

    def on_percent(self, word, value, ending, before, after):
        if self.amount is None:
            self.emit(word)
        elif word == "percent":
            self.emit(f"{self.amount}%")
        elif after == "cent":
            self.emit(f"{self.amount}%")
            self.skip = True
        else:
            self.flush()
            self.emit(word)

    @staticmethod
    def goes_on(after: str | None) -> bool:
        return after in LEXICON or bool(after and _NUMERIC.match(after))

    def on_special(self, word, value, ending, before, after):
        if self.goes_on(after):
            if word == "and" and _kind(before) == "power":
                return
            if word == "point":
                if after in DECIMALS or _NUMERIC.match(after):
                    self.amount = self.digits(".")
                return
            if word in ("double", "triple") and _kind(after) in ("unit", "zero"):
                self.amount = self.digits(str(LEXICON[after][1]) * (2 if word == "double" else 3))
                self.skip = True
                return
        self.flush()
        self.emit(word)


def _half(m: re.Match) -> str:
    if m[1] is None:
        return ""
    return f"{m[1]} point five " if m[1] in HALF_AFTER else f"{m[1]} and a half "


def _replaced(text: str, pairs: list[tuple[str, str]]) -> str:
    for pattern, to in pairs:
        text = re.sub(pattern, re.sub(r"\$(\d)", r"\\\1", to), text)
    return text


def standardize(text: str) -> str:
    words = _replaced(_HALVES.sub(_half, text), SPACED).split()
    return _replaced(" ".join(Reading(words).run()), CENTS)
