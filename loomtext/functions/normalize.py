"""English text normalization as column expressions.

The steps are data: ordered (pattern, replacement) pairs that one fold turns into nested
``regexp_replace`` calls. Every pattern has the flag ``U``, by which the JVM's classes and word
boundaries are Unicode's. Compatibility decomposition is ICU's, which Spark ships, called where a text
has letters beyond ASCII. No step needs Python.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import numbers

# Letters whose plain forms decomposition doesn't give.
PLAIN_LETTERS = {
    "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "æ": "ae", "Æ": "AE", "ß": "ss", "ẞ": "SS",
    "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "þ": "th", "Þ": "th", "ł": "l", "Ł": "L",
}

# What goes before contractions are written out.
BRACKETS = [(r"[<\[][^>\]]*[>\]]", ""), (r"\(([^)]+?)\)", "")]
FILLERS = [(r"\b(hmm|mm|mhm|mmm|uh|um)\b", ""), (r"\s+'", "'")]

# Words and their full forms, applied in this order.
CONTRACTIONS = [
    (r"\bwon't\b", "will not"), (r"\bcan't\b", "can not"), (r"\blet's\b", "let us"), (r"\bain't\b", "aint"), (r"\by'all\b", "you all"),
    (r"\bwanna\b", "want to"), (r"\bgotta\b", "got to"), (r"\bgonna\b", "going to"), (r"\bi'ma\b", "i am going to"), (r"\bimma\b", "i am going to"),
    (r"\bwoulda\b", "would have"), (r"\bcoulda\b", "could have"), (r"\bshoulda\b", "should have"), (r"\bma'am\b", "madam"),
]
TITLES = [
    ("mr", "mister"), ("mrs", "missus"), ("st", "saint"), ("dr", "doctor"), ("prof", "professor"), ("capt", "captain"), ("gov", "governor"),
    ("ald", "alderman"), ("gen", "general"), ("sen", "senator"), ("rep", "representative"), ("pres", "president"), ("rev", "reverend"),
    ("hon", "honorable"), ("asst", "assistant"), ("assoc", "associate"), ("lt", "lieutenant"), ("col", "colonel"), ("jr", "junior"),
    ("sr", "senior"), ("esq", "esquire"),
]
ENDINGS = [
    (r"'d been\b", " had been"), (r"'s been\b", " has been"), (r"'d gone\b", " had gone"), (r"'s gone\b", " has gone"), (r"'d done\b", " had done"),
    (r"'s got\b", " has got"), (r"n't\b", " not"), (r"'re\b", " are"), (r"'s\b", " is"), (r"'d\b", " would"), (r"'ll\b", " will"), (r"'t\b", " not"),
    (r"'ve\b", " have"), (r"'m\b", " am"),
]
FULL_FORMS = [*CONTRACTIONS, *((rf"\b{short}\b", f"{full} ") for short, full in TITLES), *ENDINGS]
#: One look that finds whatever any pattern of brackets, fillers and full forms would: all others have an apostrophe.
_SPOKEN_FORM = rf"[<\[(']|\b(?:hmm|mm|mhm|mmm|uh|um|wanna|gotta|gonna|imma|woulda|coulda|shoulda|{'|'.join(short for short, _ in TITLES)})\b"

# Commas in numbers, stops that end something; at the end, signs without a number.
STOPS = [(r"(\d),(\d)", "$1$2"), (r"\.([^0-9]|$)", " $1")]
LONE_SIGNS = [(r"[.$¢€£]([^0-9])", " $1"), (r"([^0-9])%", "$1 "), (r"\s+", " ")]
KEPT_SIGNS = ".%$¢€£"


def replaced(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """The replacements in order; ``d`` makes ``$`` stand before a line feed only."""
    return reduce(lambda c, p: F.regexp_replace(c, f"(?Ud){p[0]}", p[1]), pairs, text)


def replaced_where(text: Column, sign: str, pairs: list[tuple[str, str]]) -> Column:
    """The same, where texts without ``sign`` are known to hold none of the patterns: those take one look."""
    return F.when(text.rlike(f"(?Ud){sign}"), replaced(text, pairs)).otherwise(text)


def decomposed(text: Column) -> Column:
    """Compatibility decomposition (NFKD); null stays null."""
    foreign = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("decompose"), F.coalesce(text, F.lit("")), F.lit(True))
    return F.when(text.rlike(r"[^\x00-\x7F]"), foreign).otherwise(text)


def plain_symbols(text: Column, keep: str = "") -> Column:
    """Decomposed letters without marks; other marks, signs and punctuation, but those kept, as blanks."""
    # a kept character stands before the table of letters and the classes
    kept = "".join(f"\\x{{{ord(c):x}}}" for c in keep)
    but = f"&&[^{kept}]" if keep else ""
    lettered = reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), [(a, b) for a, b in PLAIN_LETTERS.items() if a not in keep], decomposed(text))
    # neither those letters nor marks are ASCII
    unmarked = F.when(text.rlike(r"[^\x00-\x7F]"), F.regexp_replace(lettered, f"[\\p{{Mn}}{but}]", "")).otherwise(text)
    return F.regexp_replace(unmarked, f"[\\p{{M}}\\p{{S}}\\p{{P}}{but}]", " ")


def plain_spelling(df: DataFrame, column: str, spelling: DataFrame, into: str) -> DataFrame:
    """Words replaced by ``spelling`` (src, dst), joined by one blank, as a new column of ``df``.

    Of a repeated src the last dst counts: the one of greatest ``position`` where the table has that column,
    as in a JSON object, else the greatest by code point. A null src is no word, a null dst leaves a word as it is.
    Each distinct text is worked on once and found again by its digest, so a text of a third of all
    rows is one, and repeated tasks give the same rows. Its words are joined to the table by key:
    broadcast while Spark's own size threshold allows it, shuffled beyond.
    """
    taken = {c.lower() for c in df.columns}
    name = lambda n: next(x for x in (f"{'_' * k}{n}" for k in range(2, 99)) if x not in taken)
    key, text = name("key"), name("text")
    digest = F.sha2(F.col(f"`{column}`").cast("string"), 256)
    texts = df.select(digest.alias("key"), F.col(f"`{column}`").cast("string").alias("text")).where("text is not null").groupBy("key").agg(F.first("text").alias("text"))
    words = texts.select("key", F.posexplode(F.filter(F.split("text", r"(?U)\s+"), lambda w: w != "")).alias("at", "word"))
    last = F.struct("position", "dst") if "position" in spelling.columns else F.struct("dst")
    table = spelling.where("src is not null and dst is not null").groupBy("src").agg(F.max(last)["dst"].alias("dst"))
    mapped = words.join(table, F.col("word") == F.col("src"), "left").select("key", F.struct("at", F.coalesce("dst", "word").alias("word")).alias("word"))
    joined = mapped.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list("word")), lambda x: x["word"]), " ").alias(text)).withColumnRenamed("key", key)
    out = df.withColumn(into, F.col(f"`{column}`")).join(joined, digest == F.col(key), "left")
    return out.withColumn(into, F.when(F.col(f"`{into}`").isNotNull(), F.coalesce(F.col(text), F.lit("")))).drop(key, text)


def spelled(text: Column, spelling: dict[str, str] | None) -> Column:
    """The same for a small table given as a dict; words joined by one blank."""
    words = F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")
    if spelling:
        table = F.create_map(*[F.lit(x) for pair in spelling.items() for x in pair])
        words = F.transform(words, lambda w: F.coalesce(F.element_at(table, w), w))
    return F.array_join(words, " ")


def once(df: DataFrame, text: Column, into: str) -> DataFrame:
    """``df`` with a column that is worked out once a row. It passes through a generator of one row, which
    the optimizer doesn't see through: else each use of it would hold all its steps again."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c != into], F.inline_outer(F.array(F.struct(text.alias(into)))))


def with_normalized(df: DataFrame, text: str, into: str, spelling: dict[str, str] | None = None) -> DataFrame:
    """``df`` plus the whole normalization of a column, each step in the plan once. Null stays null."""
    at = "__text"
    out = once(df, F.lower(F.col(text)), at)
    out = once(out, replaced_where(F.col(at), _SPOKEN_FORM, [*BRACKETS, *FILLERS, *FULL_FORMS]), at)
    out = once(out, replaced_where(F.col(at), "[,.]", STOPS), at)
    out = once(out, plain_symbols(F.col(at), KEPT_SIGNS), at)
    out = once(out, numbers.standardized(at), at)
    return out.withColumn(into, replaced(spelled(F.col(at), spelling), LONE_SIGNS)).drop(at)


def before_numbers(text: Column) -> Column:
    """The steps that come before spoken numbers."""
    return plain_symbols(replaced(F.lower(text), [*BRACKETS, *FILLERS, *FULL_FORMS, *STOPS]), KEPT_SIGNS)


def normalized(text: Column, spelling: dict[str, str] | None = None, with_numbers: bool = True) -> Column:
    """The whole normalization; null stays null. ``with_numbers`` false is for texts known to hold none."""
    out = before_numbers(text)
    out = numbers.standardized(out) if with_numbers else out
    return replaced(spelled(out, spelling), LONE_SIGNS)
