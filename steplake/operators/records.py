"""Records of a run: contracts, subtasks, nodes, tool tables, stream items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.loose import first_text
from ..functions.text import safe_short, strip
from .selection import best_per_group
from .trajectory import repaired_ids

#: Spellings of a contract's list of subtasks, and of a subtask's description, first wins (fixed values).
SUBTASKS = ("$['sub-tasks']", "$.sub_tasks", "$.subtasks")
DESCRIPTIONS = ("$.description", "$.objective", "$.task", "$.name")
#: Lengths to which a visual node's texts are shortened (fixed values).
SHORT, LONG = 4000, 48000


def kept_keys(m: Column, declared: tuple[str, ...]) -> Column:
    """Only the declared keys of a map."""
    return F.map_filter(m, lambda k, _: k.isin(*declared))


def without_keys(m: Column, other: Column) -> Column:
    """A map's entries whose key another map lacks."""
    return F.map_filter(m, lambda k, _: ~F.map_contains_key(other, k))


def overlaid(defaults: Column, *layers: Column) -> Column:
    """Maps of settings, later ones over earlier ones; null values don't overlay."""
    out = defaults
    for layer in layers:
        new = F.map_filter(F.coalesce(layer, F.create_map().cast("map<string,string>")), lambda _, v: v.isNotNull())
        out = F.map_concat(without_keys(out, new), new)
    return out


def missing_fields(m: Column, required: tuple[str, ...]) -> Column:
    """Required keys that a map lacks, or has without a value."""
    names = F.array(*map(F.lit, required))
    return F.filter(names, lambda k: F.coalesce(F.try_element_at(m, k), F.lit("")) == "")


def field_or(v: Column, *paths: str, default: str = "") -> Column:
    """The first of some fields of a variant that has text, trimmed."""
    return F.coalesce(*(F.nullif(strip(F.try_variant_get(v, p, "string")), F.lit("")) for p in paths), F.lit(default))


def whole_number(v: Column) -> Column:
    """An integer: a number cut towards zero, a string of digits alone, else null."""
    s = F.try_variant_get(v, "$", "string")
    kind = F.schema_of_variant(v)
    return F.when(kind == "STRING", F.when(strip(s).rlike(r"^[+-]?\d+$"), strip(s).try_cast("bigint"))).otherwise(F.try_variant_get(v, "$", "double").try_cast("bigint"))


def subtask_list(v: Column) -> Column:
    """The subtasks of a contract under any spelling: a list, an object's values (by key),
    or a single text; null if there are none."""

    def at(path: str) -> Column:
        inner = F.try_variant_get(v, path, "variant")
        text = F.when((F.schema_of_variant(inner) == "STRING") & (F.try_variant_get(v, path, "string") != ""), F.array(inner))
        rows = F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.map_values(F.try_variant_get(v, path, "map<string,variant>")), text)
        return F.when(F.size(rows) > 0, rows)

    return F.coalesce(*map(at, SUBTASKS))


def subtasks(df: DataFrame, key: str, contract: Column) -> DataFrame:
    """``key, id, subtask_type, input, expected_output, description``: a contract's subtasks, normalised.

    ``contract`` is JSON text; one that lists no subtask has one, made of its own
    fields. ``input`` and ``expected_output`` are JSON texts, the contract's where
    the subtask has no such key; an explicit null stays. Ids are made unique in
    list order. All is done within the row, so nothing is shuffled.
    """
    v = F.try_parse_json(F.coalesce(contract, F.lit("{}")))
    rows = df.select(F.col(key), v.alias("_v"), subtask_list(v).alias("_list"))
    own = lambda name: F.coalesce(F.to_json(F.try_variant_get("_v", f"$.{name}", "variant")), F.lit('""'))
    described = lambda e: F.when(F.schema_of_variant(e).startswith("OBJECT"), field_or(e, *DESCRIPTIONS)).otherwise(strip(F.try_variant_get(e, "$", "string")))
    given = lambda e, name: F.to_json(F.try_variant_get(e, f"$.{name}", "variant"))

    def item(e: Column) -> Column:
        return F.struct(
            F.when(F.schema_of_variant(e).startswith("OBJECT"), whole_number(F.try_variant_get(e, "$.id", "variant"))).alias("id"),
            field_or(e, "$.subtask_type", default="reasoning").alias("subtask_type"),
            F.coalesce(given(e, "input"), F.col("_input")).alias("input"),
            F.coalesce(given(e, "expected_output"), F.col("_output")).alias("expected_output"),
            described(e).alias("description"),
        )

    alone = F.array(F.struct(F.lit(1).cast("bigint").alias("id"), F.lit("reasoning").alias("subtask_type"), F.col("_input").alias("input"), F.col("_output").alias("expected_output"), field_or(F.col("_v"), "$.task_description").alias("description")))
    rows = rows.withColumns({"_input": own("input"), "_output": own("expected_output")})
    rows = rows.select(key, F.coalesce(F.transform("_list", item), alone).alias("_items"))
    each = rows.select(key, F.inline(F.arrays_zip(repaired_ids(F.transform("_items", lambda x: x["id"])).alias("id"), F.col("_items").alias("item"))))
    text = F.when(F.col("item.description") == "", F.concat(F.lit("Subtask "), F.col("id").cast("string"))).otherwise(F.col("item.description"))
    return each.select(key, "id", "item.subtask_type", "item.input", "item.expected_output", text.alias("description"))


def node_record(node_id: Column, subtask_id: Column, node_type: Column, description: Column, result: Column, depth: Column, log_path: Column) -> Column:
    """A new node of a trajectory, before it is judged."""
    return F.struct(
        node_id.alias("node_id"), depth.alias("depth"), subtask_id.alias("subtask_id"), node_type.alias("node_type"), description.alias("description"),
        result.alias("result"), result.alias("theoretician_output"), F.coalesce(log_path, F.lit("")).alias("log_path"), F.lit(0.0).alias("reward"), F.lit("").alias("memory"),
    )


def completed_subtasks(nodes: DataFrame, *keys: str) -> DataFrame:
    """Of each subtask its best complete node: ``subtask_id, description, result, reward, log_path``."""
    best = best_per_group(nodes.filter("decision = 'complete'"), "subtask_id", "reward", "node_id")
    return best.select(*keys, "subtask_id", "description", "result", "reward", F.coalesce("log_path", F.lit("")).alias("log_path"))


def visual_nodes(nodes: DataFrame, *keys: str) -> DataFrame:
    """Nodes as a page shows them: texts shortened, defaults and constants filled in."""
    return nodes.select(
        *keys, "node_id", "parent_id", "depth", F.coalesce("node_type", F.lit("draft")).alias("node_type"), safe_short(F.col("description"), SHORT).alias("description"),
        F.coalesce(F.col("reward").cast("double"), F.lit(0.0)).alias("reward"), F.lit(1).alias("visits"), F.lit("completed").alias("status"), F.lit("supervisor").alias("created_by"),
        safe_short(F.col("memory"), SHORT).alias("memory"), safe_short(F.col("theoretician_output"), LONG).alias("theoretician_output"),
        first_text(F.col("evaluation"), F.col("critic_feedback"), F.lit("{}")).alias("critic_feedback"),
    )


def tool_names(tools: DataFrame, name: str = "name", server: str | None = None, allowed: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``safe_name``, the name with _ for -. Of the one named server only allowed tools
    stay. The two columns are the map in both directions; of equal names the last server wins."""
    kept = tools if server is None else tools.filter((F.col("server") != server) | F.col(name).isin(*allowed))
    return kept.groupBy(F.replace(F.col(name), F.lit("-"), F.lit("_")).alias("safe_name")).agg(F.max_by(F.struct("server", name), F.struct("server", name)).alias("t")).select("safe_name", "t.*")


def calls(requests: DataFrame, tools: DataFrame, called: str) -> DataFrame:
    """Requests with the server and original name of the tool they call; ``known`` is false for no such tool."""
    t = tools.select(F.col("safe_name").alias("_safe"), F.col("server").alias("tool_server"), F.col("name").alias("tool_name"))
    return requests.join(t, requests[called] == t["_safe"], "left").drop("_safe").withColumn("known", F.col("tool_name").isNotNull())


def stream_item(main: Column, content: Column, state: Column) -> Column:
    """An item of a session's stream with its defaults."""
    return F.struct(main.alias("main_stream_type"), F.lit("").alias("sub_stream_type"), content.alias("content"), F.lit(True).alias("from_sandbox"), state.alias("stream_state"), F.lit("{}").alias("other_info"))


def content_parts(parts: Column) -> Column:
    """Of a reply's parts (structs ``type, text, data, resource``) what each kind carries; other kinds are left out."""
    value = F.transform(parts, lambda p: F.when(p["type"] == "text", p["text"]).when(p["type"] == "image", p["data"]).when(p["type"] == "resource", p["resource"]))
    known = F.filter(F.arrays_zip(parts.alias("p"), value.alias("v")), lambda x: x["p"]["type"].isin("text", "image", "resource"))
    return F.transform(known, lambda x: x["v"])


def parsed_or_text(x: Column) -> Column:
    """JSON as a variant; what doesn't parse as its own text."""
    return F.coalesce(F.try_parse_json(x), F.try_parse_json(quoted(x)))


def quoted(x: Column) -> Column:
    """A text as a JSON string."""
    return F.regexp_replace(F.regexp_replace(F.to_json(F.array(x)), r"^\[", ""), r"\]$", "")


def web_answer(x: Column) -> Column:
    """From the first { to the last }, with LaTeX signs repaired, if it parses; else what
    follows the last closing think tag; else the text itself."""
    s = F.nullif(F.regexp_extract(x, r"(?s)(\{.*\})", 1), F.lit(""))
    fixed = F.replace(F.replace(s, F.lit("\\("), F.lit("\\\\(")), F.lit("\\)"), F.lit("\\\\)"))
    return F.when(F.try_parse_json(fixed).isNotNull(), fixed).when(F.contains(x, F.lit("</think>")), strip(F.substring_index(x, "</think>", -1))).otherwise(x)


def browser_json(x: Column) -> Column:
    """The whole text, else its first fenced block, else from the first { to the last }; null if that doesn't parse."""
    valid = lambda c: F.when(F.try_parse_json(c).isNotNull(), c)
    block = F.nullif(F.regexp_extract(x, r"```(?:json)?\s*([\s\S]*?)```", 1), F.lit(""))
    return F.coalesce(valid(F.nullif(strip(x), F.lit(""))), valid(strip(block)), valid(F.nullif(F.regexp_extract(x, r"(?s)(\{.*\})", 1), F.lit(""))))


def at_least_one(x: Column) -> Column:
    """A count, 1 at least."""
    return F.greatest(F.lit(1), x.cast("bigint"))


def with_code(df: DataFrame, code: str) -> DataFrame:
    """Requests whose code isn't blank."""
    return df.filter(strip(F.coalesce(F.col(code), F.lit(""))) != "")


def reward_band(r: Column) -> Column:
    """The band that guidance gives a reward; nothing enforces it."""
    return F.when(r >= 0.85, "high").when(r >= 0.60, "middle").otherwise("low")


def first_seen(events: DataFrame, session: str, order: str) -> DataFrame:
    """Sessions, each with the event that creates it."""
    return events.groupBy(session).agg(F.min(order).alias("created_by"))


def indexed_edges(edges: DataFrame, nodes: DataFrame, node: str, index: str) -> DataFrame:
    """Edges with the index of both ends; an edge with an unknown end is left out."""
    ends = nodes.select(F.col(node).alias("_n"), F.col(index).alias("_i"))
    a = edges.join(ends, edges["parent_id"] == ends["_n"]).withColumnRenamed("_i", "source").drop("_n")
    return a.join(ends, a["child_id"] == ends["_n"]).withColumnRenamed("_i", "target").drop("_n")


def scope_lines(items: Column, most: int = 6) -> Column:
    """The first items as indented bullets."""
    return F.array_join(F.transform(F.slice(items, 1, most), lambda s: F.concat(F.lit("    - "), s)), "\n")


def manifest_line(skill_id: Column, domain: Column, goal: Column, scope: Column) -> Column:
    """A manifest's entry: id, domain, goal on one line, first scope items; what is empty is left out."""
    from ..functions.text import one_line

    d, g, s = strip(F.coalesce(domain, F.lit(""))), one_line(goal), scope_lines(F.coalesce(scope, F.array().cast("array<string>")))
    part = lambda head, x: F.when(x != "", F.concat(F.lit(head), x)).otherwise("")
    return F.concat(F.lit("- skill_id: "), skill_id, part("\n  domain: ", d), part("\n  goal: ", g), part("\n  scope:\n", s))


def skill_full(name: Column, path: Column, text: Column) -> Column:
    """A skill's whole text in its frame (fixed values)."""
    return F.concat(F.lit("<SKILL_FULL>\nname: "), name, F.lit("\npath: "), path, F.lit("\n---\n"), strip(text), F.lit("\n</SKILL_FULL>"))
