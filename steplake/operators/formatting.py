"""Rows as numbered or bulleted text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ordered(df: DataFrame, key: str, order: str, line: Column, tie: str | None) -> DataFrame:
    """``r``: a key's lines in order, of equals by ``tie``; a null line is an empty one."""
    row = F.struct(F.col(order).alias("o"), *([F.col(tie).alias("t")] if tie else []), F.coalesce(line, F.lit("")).alias("l"))
    return df.groupBy(key).agg(F.sort_array(F.collect_list(row)).alias("r"))


def listed(df: DataFrame, key: str, order: str, line: Column, name: str, tie: str | None = None) -> DataFrame:
    """Lines of each key in order, joined: one row per key."""
    rows = ordered(df, key, order, line, tie)
    return rows.select(key, F.array_join(F.transform("r", lambda x: x["l"]), "\n").alias(name))


def numbered(df: DataFrame, key: str, order: str, body: Column, name: str, tie: str | None = None) -> DataFrame:
    """``1. body`` and so on for each key; an entry without text keeps its number."""
    rows = ordered(df, key, order, body, tie)
    return rows.select(key, F.array_join(F.transform("r", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["l"])), "\n").alias(name))


def parsed_block(score: Column, content: Column, urls: Column) -> Column:
    """Score, content and related links; empty lines left out."""
    links = F.transform(F.coalesce(urls, F.array().cast("array<struct<url:string,description:string>>")), lambda u: F.concat(F.lit("- "), u["url"], F.lit(": "), F.coalesce(u["description"], F.lit(""))))
    head = F.array(F.concat(F.lit("score: "), F.coalesce(score.cast("string"), F.lit(""))), F.trim(content), F.when(F.size(links) > 0, "related_urls:").otherwise(""))
    return F.array_join(F.filter(F.concat(head, links), lambda x: x != ""), "\n")


def hits(reply: Column, k: int) -> Column:
    """Hits of a search reply (an object's ``organic`` or a list): the first k, then objects only."""
    rows = F.coalesce(F.try_variant_get(reply, "$.organic", "array<variant>"), F.try_variant_get(reply, "$", "array<variant>"), F.array().cast("array<variant>"))
    field = lambda v, f: F.coalesce(F.try_variant_get(v, f"$.{f}", "string"), F.lit(""))
    objects = F.filter(F.slice(rows, 1, k), lambda v: F.schema_of_variant(v).startswith("OBJECT"))
    return F.transform(objects, lambda v: F.struct(field(v, "title").alias("title"), field(v, "link").alias("link"), field(v, "snippet").alias("snippet"), field(v, "snippet").alias("text")))


def parse_reply(reply: Column) -> Column:
    """A parse reply with defaults; one that isn't an object is content of score 0.5."""
    get = lambda f, t, d: F.coalesce(F.try_variant_get(reply, f"$.{f}", t), d)
    urls = "array<struct<url:string,description:string>>"
    obj = F.struct(get("content", "string", F.lit("")).alias("content"), get("urls", urls, F.array().cast(urls)).alias("urls"), get("score", "double", F.lit(0.0)).alias("score"))
    other = F.struct(F.coalesce(F.try_variant_get(reply, "$", "string"), F.lit("")).alias("content"), F.array().cast(urls).alias("urls"), F.lit(0.5).alias("score"))
    return F.when(F.schema_of_variant(reply).startswith("OBJECT"), obj).otherwise(other)
