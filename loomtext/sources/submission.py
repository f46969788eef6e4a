"""Submission files: writing, and checking with three rules of which the first that fails counts."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ["testset_id", "text"]
# What is said of a file.
PASSED = "Validation passed: The CSV file is valid."
BAD_COLUMNS = "Error: The CSV file must contain only the columns 'testset_id' and 'text'."
BAD_IDS = "Error: 'testset_id' must follow the format 'testXXXX' (e.g., 'test0000')."
BAD_TEXT = "Error: All values in the 'text' column must be strings."
NOT_FOUND = "Error: The specified file was not found."
EMPTY = "Error: The CSV file is empty or invalid."
UNEXPECTED = "Error: An unexpected error occurred: "

# What a CSV reader that infers types takes for missing.
MISSING = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
_NUMBER = r"^\s*[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|inf|infinity|Inf|Infinity|INF)\s*$"
_TRUTH = r"^(True|False|TRUE|FALSE|true|false)$"


#: Fields may hold line ends, and quotes in them are doubled.
_CSV = {"multiLine": True, "escape": '"'}


def write(submission: DataFrame, path: str, files: int | None = 1) -> None:
    """A folder with one CSV file, with a header: a submission is as long as its test set. Longer tables are
    written by so many tasks as ``files`` says, or by those they have if it is None, each file with a header."""
    rows = submission.select(*COLUMNS)
    rows = rows if files is None else rows.coalesce(files)
    rows.write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def verdict(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row, ``message``, for text rows (testset_id, text) under a header of ``columns``.

    A text fails if it reads as missing, or if every text reads as a number or a truth value. No rows pass.
    """
    if columns != COLUMNS:
        return rows.sparkSession.createDataFrame([(BAD_COLUMNS,)], "message string")
    text = F.col("text")
    missing = text.isNull() | text.isin(MISSING)
    ids = F.coalesce(F.bool_and(F.coalesce(F.col("testset_id").rlike(r"(?Ud)^test\d{4}$"), F.lit(False))), F.lit(True))
    typed = lambda p: F.coalesce(F.bool_and(text.rlike(p)), F.lit(False))
    texts = ~F.coalesce(F.bool_or(missing), F.lit(False)) & ~typed(_NUMBER) & ~typed(_TRUTH)
    return rows.agg(ids.alias("ids"), texts.alias("texts")).select(_first(("ids", BAD_IDS), ("texts", BAD_TEXT)).alias("message"))


def _first(*rules: tuple[str, str]) -> Column:
    out = F.lit(PASSED)
    for column, message in reversed(rules):
        out = F.when(~F.col(column), F.lit(message)).otherwise(out)
    return out


def validate(spark: SparkSession, path: str) -> str:
    """The message for a CSV file. If the first row has a field more than the header, its first field is a
    row label and the others move to the left, so an id column of that shape fails the id rule."""
    try:
        lines = spark.read.text(path)
        head = lines.limit(1).collect()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return NOT_FOUND
        return f"{UNEXPECTED}{e}"
    if not head:
        return EMPTY
    names = spark.read.options(**_CSV).option("header", True).csv(path).columns
    wide = spark.read.options(**_CSV).option("header", False).option("mode", "PERMISSIVE").csv(path, schema=", ".join(f"c{k} string" for k in range(len(names) + 1)))
    first = wide.where(F.col("c0") != names[0]).limit(1).collect()
    if first and first[0][len(names)] is not None:
        moved = spark.read.options(**_CSV).option("header", True).csv(path, schema=", ".join(f"c{k} string" for k in range(len(names) + 1)), enforceSchema=True)
        rows = moved.select(F.col("c1").alias("testset_id"), F.col("c2").alias("text")) if len(names) == 2 else moved
    else:
        rows = spark.read.options(**_CSV).option("header", True).csv(path)
    return verdict(rows, names).first()["message"]
