"""Spoken English numbers as digits, as column expressions.

Each word has one entry in a table: its kind, value and ending. Other words end whatever is pending,
so a text is cut into runs of number words, and each run is folded from left to right with a pending
amount and a pending sign. Amounts are kept as digits and worked on as text, a long at a time, so
none is too large. Texts without number words pass with one look at each word.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of numbers.
ZEROS = ("o", "oh", "zero")
UNITS = (
    "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen"
).split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
POWERS = "thousand million billion trillion quadrillion quintillion sextillion septillion octillion nonillion decillion".split()
IRREGULAR_ORDINALS = {"zeroth": (0, "th"), "first": (1, "st"), "second": (2, "nd"), "third": (3, "rd"), "fifth": (5, "th"), "twelfth": (12, "th")}
SIGNS = {"minus": "-", "negative": "-", "plus": "+", "positive": "+"}
CURRENCIES = {"pound": "£", "euro": "€", "dollar": "$", "cent": "¢"}


def _lexicon() -> dict[str, tuple[str, object, str]]:
    """word -> (kind, value, ending). A name that has two kinds keeps the one that is read first."""
    unit = {w: n for n, w in enumerate(UNITS, 1)}
    ten = {w: 10 * n for n, w in enumerate(TENS, 2)}
    power = {"hundred": 100} | {w: 1000**n for n, w in enumerate(POWERS, 1)}
    entries: list[tuple[str, str, object, str]] = [(w, "zero", 0, "") for w in ZEROS]
    entries += [(w, "unit", n, "") for w, n in unit.items()]
    entries += [("sixes" if w == "six" else f"{w}s", "unit_end", n, "s") for w, n in unit.items()]
    entries += [(w, "unit_end", n, e) for w, (n, e) in IRREGULAR_ORDINALS.items()]
    # regular ordinals, so "nineth": the usual spelling of the ninth is no number here
    entries += [(w + ("h" if w[-1] == "t" else "th"), "unit_end", n, "th") for w, n in unit.items() if n > 3 and n not in (5, 12)]
    entries += [(w, "ten", n, "") for w, n in ten.items()]
    entries += [(w[:-1] + e, "ten_end", n, end) for w, n in ten.items() for e, end in (("ies", "s"), ("ieth", "th"))]
    entries += [(w, "power", n, "") for w, n in power.items()]
    entries += [(w + end, "power_end", n, end) for w, n in power.items() for end in ("s", "th")]
    entries += [(w, "sign", s, "") for w, s in SIGNS.items()]
    entries += [(w + e, "currency", s, "") for w, s in CURRENCIES.items() for e in ("", "s")]
    entries += [("per", "percent", "", ""), ("percent", "percent", "", "")]
    entries += [(w, "special", "", "") for w in ("and", "double", "triple", "point")]
    out: dict[str, tuple[str, object, str]] = {}
    for word, *entry in entries:
        out.setdefault(word, tuple(entry))
    return out


LEXICON = _lexicon()
#: Words that may open a fraction after a point.
DECIMALS = frozenset(w for w, e in LEXICON.items() if e[0] in ("zero", "unit", "ten"))
HALF_AFTER = DECIMALS | {w for w, e in LEXICON.items() if e[0] == "power"}

# Blanks between digits and letters, but not before an ending.
SPACED = [(r"([a-z])([0-9])", "$1 $2"), (r"([0-9])([a-z])", "$1 $2"), (r"([0-9])\s+(st|nd|rd|th|s)\b", "$1$2")]
# Cents behind an amount, amounts of cents alone (the dot stands for any sign), and a single one as a word.
CENTS = [
    (r"([€£$])([0-9]+) (?:and )?¢([0-9])\b", "$1$2.0$3"), (r"([€£$])([0-9]+) (?:and )?¢([0-9]{2})\b", "$1$2.$3"),
    (r"[€£$]0.0([0-9])\b", "¢$1"), (r"[€£$]0.([0-9]{1,2})\b", "¢$1"), (r"\b1(s?)\b", "one$1"),
]
_HALF = r"(?:\band\s+a\s+half\b\s*)+"
#: A half with no word before it goes; after a number it is a decimal; after another word it stays, once.
HALVES = [(rf"^\s*{_HALF}", ""), (rf"(?<!\S)({'|'.join(sorted(HALF_AFTER))})\s*{_HALF}", "$1 point five "), (rf"(\S+)\s*{_HALF}", "$1 and a half ")]

#: An Arabic numeral, and one with a sign.
_NUMERAL = r"(?U)^\d+(\.\d+)?$"
_SIGNED = r"(?U)^[-+£€$¢]\d+(\.\d+)?$"
#: All decimal digits of Unicode but ASCII's, and ASCII's for them.
_OTHER_DIGITS = [chr(c) for c in range(0x80, 0x110000) if unicodedata.category(chr(c)) == "Nd"]
_DIGITS = "".join(_OTHER_DIGITS), "".join(str(unicodedata.decimal(c)) for c in _OTHER_DIGITS)
_CUT = "\u0001"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often it stands there."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _replaced(text: Column, pairs: list[tuple[str, str]]) -> Column:
    for pattern, to in pairs:
        text = F.regexp_replace(text, f"(?Ud){pattern}", to)
    return text


def _replaced_where(text: Column, sign: str, pairs: list[tuple[str, str]]) -> Column:
    """The same, where texts without ``sign`` are known to hold none of the patterns: those take one look."""
    return let(text, lambda t: F.when(t.rlike(f"(?Ud){sign}"), _replaced(t, pairs)).otherwise(t))


def _tail(digits: Column, n: int) -> Column:
    """The last n characters, or as many as there are."""
    return F.when(F.length(digits) > n, F.right(digits, F.lit(n))).otherwise(digits)


def _head(digits: Column, n: int) -> Column:
    """What stands before the last n characters."""
    return F.when(F.length(digits) > n, F.substring(digits, F.lit(1), F.length(digits) - n)).otherwise("")


def _more_by_one(digits: Column) -> Column:
    """The next whole number of any length; of no digits, 1."""
    core = F.rtrim(digits, F.lit("9"))
    zeros = F.repeat(F.lit("0"), F.length(digits) - F.length(core))
    last = F.when(core == "", "1").otherwise(F.concat(_head(core, 1), (F.right(core, F.lit(1)).cast("int") + 1).cast("string")))
    return F.concat(last, zeros)


_CHUNK = 15  # digits that a long adds without running over


def _plus(digits: Column, small: Column) -> Column:
    """A whole number of any length plus one of at most ``_CHUNK`` digits."""
    low = F.coalesce(F.nullif(_tail(digits, _CHUNK), F.lit("")).cast("long"), F.lit(0)) + small

    def added(total: Column) -> Column:
        high = _head(digits, _CHUNK)
        text = F.lpad(F.right(total.cast("string"), F.lit(_CHUNK)), _CHUNK, "0")
        over = total >= 10**_CHUNK
        return F.when((high == "") & ~over, total.cast("string")).otherwise(F.concat(F.when(over, _more_by_one(high)).otherwise(high), text))

    return let(low, added)


def _whole(numeral: Column) -> Column:
    """A whole number without leading zeros, from digits with a point somewhere; null if it isn't whole."""
    ascii_ = F.translate(numeral, *_DIGITS)
    return F.when(ascii_.rlike(r"^\d+(\.0*)?$"), F.regexp_replace(F.regexp_replace(ascii_, r"\..*", ""), r"^0+(?=\d)", ""))


def _times(have: Column, exact: Column, zeros: Column) -> Column:
    """A pending amount times a power of ten, of a whole number its last three digits; null if that isn't whole."""

    def of_whole(base: Column) -> Column:  # the number with its last three digits set to 0
        last = _tail(have, 3).cast("long")
        upper = F.when(F.length(base) > zeros, F.substring(base, F.lit(1), F.length(base) - zeros)).otherwise("")
        lower = F.when(F.length(base) > zeros, F.substring(base, F.length(base) - zeros + 1, zeros)).otherwise(F.lpad(base, zeros, F.lit("0")))
        return F.when(last == 0, have).when(F.length(have) <= 3, F.concat(last.cast("string"), F.repeat(F.lit("0"), zeros))).otherwise(F.concat(_plus(upper, last), lower))

    def of_other(text: Column) -> Column:
        whole, part = F.substring_index(text, ".", 1), F.rtrim(F.when(F.contains(text, F.lit(".")), F.substring_index(text, ".", -1)).otherwise(""), F.lit("0"))
        moved = F.regexp_replace(F.concat(whole, F.rpad(part, zeros, F.lit("0"))), r"^0+(?=\d)", "")
        return F.when(text.rlike(r"^(\d+\.?\d*|\.\d+)$") & (F.length(part) <= zeros), moved)

    whole = let(F.concat(_head(have, 3), F.lit("000")), of_whole)
    return F.when(exact & (have != "0"), whole).otherwise(let(F.translate(have, *_DIGITS), of_other))


class _State:
    """The pending amount (digits; ``exact`` if it is a whole number and not digits spelled one by one), the pending
    sign, whether the next word is done with, and what has been read."""

    def __init__(self, amount: Column, exact: Column, sign: Column, skip: Column, out: Column):
        self.amount, self.exact, self.sign, self.skip, self.out = amount, exact, sign, skip, out

    @classmethod
    def of(cls, s: Column) -> _State:
        return cls(*(s[n] for n in ("amount", "exact", "sign", "skip", "out")))

    def column(self) -> Column:
        return F.struct(self.amount.alias("amount"), self.exact.alias("exact"), self.sign.alias("sign"), self.skip.alias("skip"), self.out.alias("out"))

    def emitted(self, what: Column, skip: bool = False) -> _State:
        return _State(F.lit(None).cast("string"), F.lit(False), F.lit(""), F.lit(skip), F.concat(self.out, F.lit(" "), self.sign, what))

    def flushed(self) -> _State:
        done = self.amount.isNotNull()
        out = F.when(done, F.concat(self.out, F.lit(" "), self.sign, self.amount)).otherwise(self.out)
        return _State(F.lit(None).cast("string"), F.lit(False), F.when(done, F.lit("")).otherwise(self.sign), F.lit(False), out)

    def pending(self, amount: Column, exact: Column, sign: Column | None = None, skip: bool = False) -> _State:
        return _State(amount, exact, self.sign if sign is None else sign, F.lit(skip), self.out)

    def digits(self, more: Column) -> Column:
        """Digits behind the pending ones; a whole number 0 is none."""
        return F.concat(F.when(self.amount.isNull() | (self.exact & (self.amount == "0")), "").otherwise(self.amount), more)


def _joined(s: _State, t: Column, room: Column) -> tuple[Column, Column]:
    """(amount, whether it is a whole number) of the pending amount and a unit or ten: added where it ends in ``room`` zeros."""
    value = t["value"]
    ends = F.right(s.amount, F.least(room, F.length(s.amount))) == F.repeat(F.lit("0"), F.least(room, F.length(s.amount)))
    fits = s.exact & ((s.amount == "0") | ((F.length(s.amount) > room) & ends))
    spelled = (t["kind"].startswith("unit")) & (~s.exact | (t["before"] == "unit"))
    instead = spelled & (t["before"] == "ten") & (F.length(value) == 1)
    added = F.when(s.amount == "0", value).otherwise(F.concat(F.substring(s.amount, F.lit(1), F.length(s.amount) - room), F.lpad(value, room, F.lit("0"))))
    amount = F.when(s.amount.isNull(), value).when(instead, F.concat(_head(s.amount, 1), value)).when(fits & ~spelled, added).otherwise(F.concat(s.amount, value))
    return amount, s.amount.isNull() | (fits & ~spelled)


def _read(state: Column, t: Column) -> Column:
    """What a word does to the state."""
    s = _State.of(state)
    flushed = s.flushed()
    kind, value, word = t["kind"], t["value"], t["word"]
    other = flushed.emitted(word)
    sign = F.substring(word, F.lit(1), F.lit(1))
    bare = F.when(kind == "signed", F.substring(word, F.lit(2), F.length(word))).otherwise(word)
    number = let(F.struct(bare.alias("bare"), _whole(bare).alias("whole")), lambda b: flushed.pending(F.coalesce(b["whole"], b["bare"]), b["whole"].isNotNull(), F.when(kind == "signed", sign).otherwise(flushed.sign)).column())
    arabic = F.when(s.amount.isNotNull() & ~s.exact & s.amount.endswith("."), s.pending(F.concat(s.amount, word), F.lit(False)).column()).otherwise(number)
    amount, exact = _joined(s, t, F.when(kind.startswith("ten") | (F.length(value) > 1), 2).otherwise(1))

    def powered(product: Column) -> Column:
        own = _State(F.lit(None).cast("string"), F.lit(False), F.when(product.isNull(), flushed.sign).otherwise(s.sign), F.lit(False), F.when(product.isNull(), flushed.out).otherwise(s.out))
        result = F.coalesce(product, F.concat(F.lit("1"), F.repeat(F.lit("0"), value.cast("int"))))
        return F.when(kind == "power", own.pending(result, F.lit(True)).column()).otherwise(own.emitted(F.concat(result, t["ending"])).column())

    # without an amount the power itself is one, and nothing is flushed
    power = let(F.when(s.amount.isNull(), F.concat(F.lit("1"), F.repeat(F.lit("0"), value.cast("int")))).otherwise(_times(s.amount, s.exact, value.cast("int"))), powered)
    on, after = t["goes_on"], t["after"]
    percent = F.when(s.amount.isNull(), s.emitted(word).column()).when(word == "percent", s.emitted(F.concat(s.amount, F.lit("%"))).column())
    percent = percent.when(after == "cent", s.emitted(F.concat(s.amount, F.lit("%")), skip=True).column()).otherwise(other.column())
    doubled = F.repeat(t["after_value"], F.when(word == "double", 2).otherwise(3))
    special = (
        F.when(on & (word == "and") & (t["before"] == "power"), state)
        .when(on & (word == "point"), F.when(t["decimal"], s.pending(s.digits(F.lit(".")), F.lit(False)).column()).otherwise(state))
        .when(on & word.isin("double", "triple") & t["after_kind"].isin("unit", "zero"), s.pending(s.digits(doubled), F.lit(False), skip=True).column())
        .otherwise(other.column())
    )
    return (
        F.when(s.skip, _State(s.amount, s.exact, s.sign, F.lit(False), s.out).column())
        .when(kind.isin("numeral", "signed"), arabic)
        .when(kind == "zero", s.pending(s.digits(F.lit("0")), F.lit(False)).column())
        .when(kind.isin("unit", "ten"), s.pending(amount, exact).column())
        .when(kind.isin("unit_end", "ten_end"), s.emitted(F.concat(amount, t["ending"])).column())
        .when(kind.isin("power", "power_end"), power)
        .when(kind == "sign", F.when(on, flushed.pending(F.lit(None).cast("string"), F.lit(False), value).column()).otherwise(other.column()))
        .when(kind == "currency", F.when(s.amount.isNull(), s.emitted(word).column()).otherwise(_State(s.amount, s.exact, value, F.lit(False), s.out).flushed().column()))
        .when(kind == "percent", percent)
        .otherwise(special)
    )


def _value(kind: str, value: object) -> str:
    """Of a power how many zeros it has."""
    return str(len(str(value)) - 1) if kind.startswith("power") else str(value)


def _entries() -> Column:
    """The lexicon as one literal, written as SQL, which is made at once."""
    row = "'{}', named_struct('kind', '{}', 'value', '{}', 'ending', '{}')"
    return F.expr(f"map({', '.join(row.format(w, kind, _value(kind, value), ending) for w, (kind, value, ending) in LEXICON.items())})")


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def _is_number(word: Column) -> Column:
    return word.isin(*LEXICON) | (word.rlike(r"(?U)\d$") & (word.rlike(_NUMERAL) | word.rlike(_SIGNED)))


def _run(run: Column) -> Column:
    """A run of words that are all numbers, read from left to right."""
    table = _entries()
    none = F.struct(*[F.lit(None).cast("string").alias(n) for n in ("kind", "value", "ending")])

    def known(word: Column) -> Column:  # each word is looked up once
        kind = F.when(word.rlike(r"\p{Nd}"), F.when(word.rlike(_NUMERAL), "numeral").when(word.rlike(_SIGNED), "signed"))
        return F.struct(word.alias("word"), F.when(kind.isNull(), F.try_element_at(table, word)).otherwise(none).alias("own"), kind.alias("arabic"))

    def token(known_: Column) -> Callable[[Column, Column], Column]:
        def of(x: Column, k: Column) -> Column:
            before, after = F.when(k > 0, F.get(known_, k - 1)), F.get(known_, k + 1)
            numeral = F.coalesce(after["arabic"] == "numeral", F.lit(False))
            after_kind = F.coalesce(after["own"]["kind"], F.lit(""))
            return F.struct(
                x["word"].alias("word"), F.coalesce(x["arabic"], x["own"]["kind"]).alias("kind"), F.coalesce(x["own"]["value"], F.lit("")).alias("value"),
                F.coalesce(x["own"]["ending"], F.lit("")).alias("ending"), F.coalesce(before["own"]["kind"], F.lit("")).alias("before"), F.coalesce(after["word"], F.lit("")).alias("after"),
                after_kind.alias("after_kind"), F.coalesce(after["own"]["value"], F.lit("")).alias("after_value"),
                (numeral | (after_kind != "")).alias("goes_on"), (numeral | after_kind.isin("zero", "unit", "ten")).alias("decimal"),
            )

        return of

    begin = _State(F.lit(None).cast("string"), F.lit(False), F.lit(""), F.lit(False), F.lit("")).column()
    return F.aggregate(let(F.transform(F.split(run, " "), known), lambda ws: F.transform(ws, token(ws))), begin, _read, lambda s: F.substring(_State.of(s).flushed().out, F.lit(2), F.length(s["out"]) + F.length(s["sign"]) + F.length(F.coalesce(s["amount"], F.lit(""))) + 1))


def _read_all(words: Column) -> Column:
    """Words joined by one blank, each run of numbers read by itself: other words end what is pending."""

    def of(flags: Column) -> Column:
        def marked(word: Column, k: Column) -> Column:
            turned = (k > 0) & (F.get(flags, k) != F.coalesce(F.get(flags, k - 1), F.lit(False)))
            return F.concat(F.when(k == 0, "").when(turned, _CUT).otherwise(" "), word)

        runs = F.split(F.array_join(F.transform(words, marked), ""), _CUT)
        # runs of numbers and of other words take turns
        first = F.when(F.coalesce(F.get(flags, F.lit(0)), F.lit(False)), 0).otherwise(1)
        return F.array_join(F.transform(runs, lambda r, k: F.when(k % 2 == first, _run(r)).otherwise(r)), " ")

    return F.when(F.size(words) == 0, "").otherwise(let(F.transform(words, _is_number), of))


def may_hold_numbers(text: Column) -> Column:
    """False only where standardizing changes nothing but white space."""
    words = F.array(*[F.lit(w) for w in sorted(set(LEXICON) - {"and"})])
    return text.rlike(r"\p{Nd}|(?U)\band\s+a\s+half\b") | F.arrays_overlap(F.split(text, r"(?U)\s+"), words)


def _standardized(text: Column) -> Column:
    plain = F.array_join(_words(text), " ")
    whole = F.translate(_replaced_where(text, r"and\s+a\s+half", HALVES), _CUT, " ")
    read = let(_words(_replaced_where(whole, r"[a-z][0-9]|[0-9]\s*[a-z]", SPACED)), _read_all)
    return F.when(may_hold_numbers(text), _replaced_where(read, "[€£$1]", CENTS)).otherwise(plain)


#: The expression of a column by its name, for the JVM that holds it: thousands of nodes are made once.
_made: dict[str, tuple[object, Column]] = {}


def standardized(text: Column | str) -> Column:
    """Spoken numbers of a text (a column, or its name) as digits; words are joined by one blank. Null stays null."""
    if not isinstance(text, str):
        return _standardized(text)
    jvm = SparkContext._active_spark_context and SparkContext._active_spark_context._jvm
    if jvm is None:
        return _standardized(F.col(text))
    if text not in _made or _made[text][0] is not jvm:
        _made[text] = jvm, _standardized(F.col(text))
    return _made[text][1]
