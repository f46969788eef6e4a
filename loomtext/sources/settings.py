"""Nested settings as rows of (path, kind, value), with overrides of which the last one counts.

A settings file and options are small; the same rows may also be a table of any size, such as the
settings of every client with all changes made to them.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Kinds of values; text stands as it is, others as they are written in JSON.
KINDS = ("null", "boolean", "integer", "number", "text", "list")
SCHEMA = "path string, kind string, value string, position long"
_INTEGER, _NUMBER = re.compile(r"[-+]?\d+\Z"), re.compile(r"[-+]?(\d+\.\d*|\.\d+|\d+(\.\d*)?[eE][-+]?\d+)\Z")


def typed(text: str) -> tuple[str, str | None]:
    """(kind, value) of a value as it is written: quotes make text of anything, brackets a list."""
    text = text.strip()
    if text.lower() in ("", "~", "null", "none"):
        return "null", None
    if text.lower() in ("true", "false"):
        return "boolean", text.lower()
    if _INTEGER.match(text):
        return "integer", str(int(text))
    if _NUMBER.match(text):
        return "number", repr(float(text))
    if text[0] in "[(" and text[-1] in "])":
        return "list", "[" + ", ".join(x.strip() for x in text[1:-1].split(",") if x.strip()) + "]"
    if len(text) > 1 and text[0] == text[-1] and text[0] in "'\"":
        return "text", ast.literal_eval(text) if text[0] == '"' else text[1:-1].replace("''", "'")
    return "text", text


def value_of(kind: str, value: str | None):
    """The Python value of a row."""
    if kind == "null":
        return None
    if kind == "list":
        return [value_of(*typed(x)) for x in value[1:-1].split(",") if x.strip()]
    return {"boolean": lambda v: v == "true", "integer": int, "number": float, "text": str}[kind](value)


def _bare(line: str) -> str:
    """A line without its comment: a # at the beginning or after a blank, outside quotes."""
    quote = ""
    for k, c in enumerate(line):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"" and (k == 0 or line[k - 1] in " :[,"):
            quote = c
        elif c == "#" and (k == 0 or line[k - 1].isspace()):
            return line[:k].rstrip()
    return line.rstrip()


def lines(text: str) -> Iterator[tuple[str, str, str | None]]:
    """(path, kind, value) of ``key: value`` lines, nested by how far they are indented."""
    above: list[tuple[int, str]] = []
    for number, raw in enumerate(text.splitlines(), 1):
        line = _bare(raw)
        if not line.strip():
            continue
        key, colon, rest = line.strip().partition(":")
        if not colon or (rest and not rest[0].isspace()):
            raise ValueError(f"line {number} isn't a setting: {raw!r}")
        depth = len(line) - len(line.lstrip())
        while above and above[-1][0] >= depth:
            above.pop()
        path = ".".join([*(k for _, k in above), key.strip()])
        above.append((depth, key.strip()))
        if rest.strip():
            yield path, *typed(rest)


def read_settings(spark: SparkSession, path: str) -> DataFrame:
    """Settings (path, kind, value, position) of a file of nested ``key: value`` lines, from any store."""
    text = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())  # one small file
    return spark.createDataFrame([(*x, k) for k, x in enumerate(lines(text))], SCHEMA)


def options(spark: SparkSession, given: list[str]) -> DataFrame:
    """Overrides from ``path=value`` texts, in order."""
    rows = []
    for k, text in enumerate(given):
        path, sign, value = text.partition("=")
        if not sign or not path.strip():
            raise ValueError(f"an option is path=value, not {text!r}")
        rows.append((path.strip(), *typed(value), k))
    return spark.createDataFrame(rows, SCHEMA)


def merged(*layers: DataFrame) -> DataFrame:
    """(path, kind, value): of each path the row of the last layer that has it, there the one of greatest position.

    A value replaces all that stood below its path before, and a setting below a path replaces a value there, as
    in a tree. Rows are grouped by path, so a table of settings is merged by any number of machines.
    """
    rows = None
    for k, layer in enumerate(layers):
        own = layer.select("path", "kind", "value", F.struct(F.lit(k).alias("layer"), F.col("position").cast("long").alias("position")).alias("at"))
        rows = own if rows is None else rows.unionByName(own)
    last = rows.groupBy("path").agg(F.max_by(F.struct("kind", "value"), "at").alias("set"), F.max("at").alias("at"))
    names = F.split("path", r"\.")
    # every path also stands for those above it, which it clashes with
    above = F.transform(F.sequence(F.lit(1), F.size(names)), lambda n: F.array_join(F.slice(names, F.lit(1), n), "."))
    spread = last.select("path", "set", "at", F.explode(above).alias("node"))
    own = Window.partitionBy("node")
    leaf = F.max(F.when(F.col("path") == F.col("node"), F.col("at"))).over(own)
    below = F.max(F.when(F.col("path") != F.col("node"), F.col("at"))).over(own)
    stands = F.when(F.col("path") == F.col("node"), F.coalesce(F.col("at") > below, F.lit(True))).otherwise(F.coalesce(F.col("at") > leaf, F.lit(True)))
    kept = spread.select("path", "set", stands.alias("stands")).groupBy("path").agg(F.any_value("set").alias("set"), F.bool_and("stands").alias("stands"))
    return kept.where("stands").select("path", "set.kind", "set.value")


def nested(settings: DataFrame) -> dict:
    """The settings of one file as nested dictionaries of Python values."""
    out: dict = {}
    for r in settings.select("path", "kind", "value").collect():
        *above, name = r["path"].split(".")
        at = out
        for k in above:
            at = at.setdefault(k, {})
        at[name] = value_of(r["kind"], r["value"])
    return out
