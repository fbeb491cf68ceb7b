"""Functions by name in SQL, and their catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .loose import natural_text
from .text import html_to_text

#: Functions over Arrow batches, and SQL bodies of the others.
ARROW = {"html_to_text": html_to_text, "natural_text": natural_text}
SQL = {
    "tool_name": ("s STRING", "STRING", "replace(s, '-', '_')"),
    "word_overlap": ("a ARRAY<STRING>, b ARRAY<STRING>", "INT", "size(array_intersect(a, b))"),
    "match_score": ("overlap BIGINT, words BIGINT", "DOUBLE", "2 * overlap + overlap / greatest(words, 1)"),
    "elapsed_seconds": ("a TIMESTAMP, b TIMESTAMP", "DOUBLE", "(unix_micros(b) - unix_micros(a)) / 1e6"),
}


def register(spark: SparkSession) -> None:
    """Make the functions known to a session."""
    for name, f in ARROW.items():
        spark.udf.register(name, f)
    for name, (args, out, body) in SQL.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {out} RETURN {body}")


def call(name: str, schema: dict, given: dict[str, Column]) -> Column:
    """A registered function by name, its arguments in the order of a JSON schema.

    Required arguments must be given; others take their default, or null. Raises
    ValueError for an argument that is missing or unknown.
    """
    fields, required = schema.get("properties", {}), schema.get("required", [])
    wrong = [k for k in required if k not in given] + [k for k in given if k not in fields]
    if wrong:
        raise ValueError(f"{name}: missing or unknown arguments {', '.join(wrong)}")
    names = [*required, *(k for k in fields if k not in required)]
    return F.call_function(name, *(given[k] if k in given else F.lit(fields[k].get("default")) for k in names))


def session_functions(spark: SparkSession) -> DataFrame:
    """The functions that the session itself knows by these names."""
    known = [(f.name,) for f in spark.catalog.listFunctions() if f.isTemporary and f.name in {*ARROW, *SQL}]
    return spark.createDataFrame(known, "name string")


def listing(spark: SparkSession) -> DataFrame:
    """Names of the registered functions."""
    names = [(n, k) for k, xs in (("arrow", ARROW), ("sql", SQL)) for n in xs]
    return spark.createDataFrame(names, "name string, kind string").filter(F.col("name").isNotNull())
