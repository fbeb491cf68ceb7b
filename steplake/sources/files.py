"""File scans and writers."""

from __future__ import annotations

import json

import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.records import manifest_line, skill_full
from ..operators.selection import duplicates, first_wins, missing


def whole_texts(spark: SparkSession, path: str | list[str], glob: str | None = None, recursive: bool = False) -> DataFrame:
    """``path, text``: one row per file. Bodies aren't read where only paths are used."""
    r = spark.read.text(path, wholetext=True, pathGlobFilter=glob, recursiveFileLookup=recursive)
    return r.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def yaml_rows(files: DataFrame) -> DataFrame:
    """``path, data``: YAML mappings as JSON text; what isn't a mapping is left out."""

    def parse(batches):  # noqa: ANN001, ANN202
        for b in batches:
            rows = []
            for p, t in zip(b["path"], b["text"], strict=True):
                try:
                    x = yaml.safe_load(t)
                except yaml.YAMLError:
                    continue
                if isinstance(x, dict):
                    rows.append((p, json.dumps(x, ensure_ascii=False, default=str)))
            yield b.iloc[:0].assign(data=None)[["path", "data"]] if not rows else b.__class__(rows, columns=["path", "data"])

    return files.mapInPandas(parse, "path string, data string")


def skills(spark: SparkSession, roots: list[str]) -> DataFrame:
    """``name, description, summary, path, root``: skill files under some roots; the first root wins a name."""
    out = None
    for i, root in enumerate(dict.fromkeys(roots)):
        files = whole_texts(spark, root, "SKILL.md", True).withColumns({"root": F.lit(root), "root_pos": F.lit(i)})
        out = files if out is None else out.unionByName(files)
    meta = T.front_matter(F.col("text"))
    folder = F.element_at(F.split("path", "/"), -2)
    rows = out.select(
        F.coalesce(F.nullif(F.try_element_at(meta, F.lit("name")), F.lit("")), folder).alias("name"),
        F.coalesce(F.try_element_at(meta, F.lit("description")), F.lit("")).alias("description"),
        T.first_paragraph(F.col("text")).alias("summary"), "path", "root", "root_pos",
    )
    return first_wins(rows, "name", "root_pos", "path").drop("root_pos")


def skill_brief(found: DataFrame) -> DataFrame:
    """One text that lists the skills by name."""
    note = F.coalesce(F.nullif("description", F.lit("")), F.col("summary"))
    line = F.concat(F.lit("- skill_name: "), "name", F.when(note != "", F.concat(F.lit("\n  description: "), note)).otherwise(""), F.lit("\n  path: "), "path")
    rows = found.agg(F.sort_array(F.collect_list(F.struct(F.lower("name").alias("o"), F.col("path").alias("p"), line.alias("l")))).alias("r"))
    return rows.select(F.when(F.size("r") == 0, "No installed skills were found.").otherwise(F.array_join(F.transform("r", lambda x: x["l"]), "\n")).alias("brief"))


def workflows(spark: SparkSession, path: str) -> DataFrame:
    """``path, goal, data``: workflow files of a folder, or one file; without a goal left out."""
    rows = yaml_rows(whole_texts(spark, path, "*.y*ml"))
    v = F.parse_json("data")
    goal = F.coalesce(*(F.try_variant_get(v, f"$.{a}.{b}", "string") for a in ("Workflow", "workflow") for b in ("Goal", "goal")))
    return rows.select("path", goal.alias("goal"), "data").filter("goal is not null and goal <> ''")


def fetched(link, body, fallback):  # noqa: ANN001, ANN201
    """``ok, text`` of a page: PDFs are refused by name or content, a fallback text
    stands in for no body, and the failure mark anywhere fails."""
    text = F.coalesce(F.nullif(body, F.lit("")), F.nullif(fallback, F.lit("")))
    bad = F.lower(link).endswith(".pdf") | text.isNull() | F.startswith(text, F.lit("%PDF")) | F.contains(text, F.lit("Failed to fetch web page"))
    return F.struct((~F.coalesce(bad, F.lit(True))).alias("ok"), F.when(~bad, text).otherwise("").alias("text"))


def write_json(df: DataFrame, path: str, *keys: str) -> None:
    """JSON rows, a folder for each value of the keys."""
    df.write.mode("overwrite").partitionBy(*keys).json(path)


def write_html(payload: DataFrame, template: str, marker: str, path: str) -> None:
    """One page: the rows as JSON in the place of the marker."""
    rows = payload.agg(F.to_json(F.collect_list(F.struct(*payload.columns))).alias("j"))
    rows.select(F.replace(F.lit(template), F.lit(marker), F.col("j")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_markdown(df: DataFrame, column: str, path: str) -> None:
    """Texts that end with one line end."""
    df.select(F.regexp_replace(column, r"\n*$", "").alias("value")).coalesce(1).write.mode("overwrite").text(path)


def single_workflow(spark: SparkSession, path: str) -> DataFrame:
    """A workflow file's row; none where the path is no file."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p) or not fs.getFileStatus(p).isFile():
        return spark.createDataFrame([], "path string, goal string, data string")
    return workflows(spark, path)


def json_document(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON files, one document each, over any number of lines."""
    r = spark.read.schema(schema) if schema else spark.read
    return r.json(path, multiLine=True)


#: Bytes after which a page isn't read on (fixed value).
READ_CAP = 2 << 20


def capped(body: Column) -> Column:
    """The first READ_CAP bytes of a body as text; what isn't UTF-8 becomes the replacement mark."""
    return F.make_valid_utf8(F.substring(body.cast("binary"), 1, READ_CAP).cast("string"))


def first_fetched(proxy: Column, direct: Column) -> Column:
    """What the proxy gave, else what a direct fetch gave, capped."""
    return F.coalesce(F.nullif(proxy, F.lit("")), F.nullif(capped(direct), F.lit("")))


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """``skill_id, domain, goal, scope, skill_path`` of all ``skill.yaml`` files under a root.

    Raises ValueError that names the first ten files without a skill_id, or every
    skill_id of several files. A scope that is a text is a list of one.
    """
    rows = yaml_rows(whole_texts(spark, root, "skill.yaml", True))
    v = F.parse_json("data")
    text = lambda name: F.coalesce(F.try_variant_get(v, f"$.{name}", "string"), F.lit(""))
    scope = F.coalesce(F.try_variant_get(v, "$.scope", "array<string>"), F.when(text("scope") != "", F.array(text("scope"))), F.array().cast("array<string>"))
    found = rows.select(text("skill_id").alias("skill_id"), text("domain").alias("domain"), text("goal").alias("goal"), scope.alias("scope"), F.col("path").alias("skill_path"))
    bad = [r.skill_path for r in found.filter("skill_id = ''").orderBy("skill_path").limit(10).collect()]
    if bad:
        raise ValueError("manifests without skill_id (10 at most): " + ", ".join(bad))
    twice = duplicates(found, "skill_id", "skill_path").orderBy("skill_id").limit(10).collect()
    if twice:
        raise ValueError("skill_id of several manifests: " + "; ".join(f"{r.skill_id}: {r.first_path}, {r.later}" for r in twice))
    return found


def write_manifest_text(found: DataFrame, path: str) -> None:
    """The manifests as one text, sorted by domain and id."""
    entry = manifest_line(F.col("skill_id"), F.col("domain"), F.col("goal"), F.col("scope"))
    rows = found.select(F.lower("domain").alias("d"), F.lower("skill_id").alias("i"), F.concat(entry, F.lit("\n")).alias("value"))
    rows.coalesce(1).sortWithinPartitions("d", "i").select("value").write.mode("overwrite").text(path)


def skill_specs(found: DataFrame, spark: SparkSession, names: list[str]) -> DataFrame:
    """``pos, block``: the named skills' whole texts in the order asked for, repeats kept.

    Raises ValueError that names those that aren't there.
    """
    asked = spark.createDataFrame(list(enumerate(names)), "pos long, name string")
    gone = sorted(r.name for r in missing(asked, found, "name").select("name").distinct().collect())
    if gone:
        raise ValueError("no such skills: " + ", ".join(gone))
    rows = asked.join(found, "name")
    files = whole_texts(spark, [r.path for r in rows.select("path").distinct().collect()])
    return rows.join(files, "path").orderBy("pos").select("pos", skill_full(F.col("name"), F.col("path"), F.col("text")).alias("block"))
