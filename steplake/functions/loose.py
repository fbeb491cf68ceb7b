"""Loosely formatted values: JSON in prose, numbers in strings, decisions, routing."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Decisions and the verdict each stands for (fixed values).
VERDICTS = {"complete": "accept", "to_revise": "refine", "to_redraft": "reject"}
FENCE = r"```(?:json)?\s*([\s\S]*?)```"


def lenient_json(c: Column) -> Column:
    """A JSON value in a text, as text: the whole, else the first fenced block that
    parses, else from the first { to the last }, else from [ to ]; else {}."""
    valid = lambda x: F.when(F.try_parse_json(x).isNotNull(), x)
    s = F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")
    blocks = F.filter(F.transform(F.regexp_extract_all(s, F.lit(FENCE), F.lit(1)), lambda b: valid(F.regexp_replace(b, r"^\s+|\s+$", ""))), lambda b: b.isNotNull())
    span = lambda p: valid(F.nullif(F.regexp_extract(s, p, 1), F.lit("")))
    return F.coalesce(valid(F.nullif(s, F.lit(""))), F.get(blocks, F.lit(0)), span(r"(?s)(\{.*\})"), span(r"(?s)(\[.*\])"), F.lit("{}"))


def braces_json(c: Column) -> Column:
    """From the first { to the last }, if that parses; else a record of the failure."""
    s = F.nullif(F.regexp_extract(c, r"(?s)(\{.*\})", 1), F.lit(""))
    failed = F.to_json(F.struct(c.alias("raw_output"), F.lit("no JSON object").alias("error")))
    return F.when(F.try_parse_json(s).isNotNull(), s).otherwise(failed)


def _natural(v: object) -> str:
    if v is None:
        return ""
    if isinstance(v, list):
        return " ".join(filter(None, map(_natural, v)))
    if isinstance(v, dict):
        return "; ".join(f"{k}: {t}" for k, t in ((k, _natural(x)) for k, x in v.items()) if t)
    return str(v).strip()


@F.pandas_udf(StringType())
def natural_text(s: pd.Series) -> pd.Series:
    """JSON flattened to prose. Recursive, so an Arrow function; bad JSON is text itself."""

    def one(x: str | None) -> str:
        try:
            return _natural(json.loads(x)) if x else ""
        except ValueError:
            return x.strip()

    return s.map(one)


def reward(c: Column) -> Column:
    """A number, or 0 for what isn't one; never clamped."""
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


def whole(c: Column) -> Column:
    """An integer, or null."""
    return c.try_cast("bigint")


def decision(c: Column) -> Column:
    d = F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", ""))
    return F.when(d.isin(*VERDICTS), d).otherwise("to_revise")


def verdict(given: Column, decided: Column) -> Column:
    """The verdict given, or the one that the decision stands for."""
    out = F.when(F.lit(False), "")
    for d, v in VERDICTS.items():
        out = out.when(decided == d, v)
    return F.coalesce(F.nullif(F.lower(F.trim(given)), F.lit("")), out.otherwise("refine"))


def first_text(*columns: Column) -> Column:
    """The first that is neither null nor empty, else an empty text."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns), F.lit(""))


def md5_route(c: Column, workers: int) -> Column:
    """MD5 as a number, modulo ``workers``, digit by digit."""
    digits = F.split(F.md5(c.cast("string").cast("binary")), "")
    return F.aggregate(F.filter(digits, lambda d: d != ""), F.lit(0), lambda a, d: (a * 16 + F.conv(d, 16, 10).cast("int")) % workers)


def blocked_mode(c: Column) -> Column:
    """File modes that write."""
    return F.lower(c).rlike("[wa+]")


def is_terminal(sub_type: Column, state: Column) -> Column:
    """The event that ends a session's stream."""
    return (F.coalesce(sub_type, F.lit("")) == "") & (state == "end")
