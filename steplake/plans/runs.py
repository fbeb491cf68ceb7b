"""Queries of contracts, nodes, tools, manifests and stream items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import loose as J
from ..functions import text as T
from ..operators import formatting, records, selection
from ..streaming import sessions
from .catalogue import DECIDED, query


def chosen(*values: str):  # noqa: ANN201
    """One of some values by the document's id, {id} filled in."""
    out = F.lit(values[-1])
    for i, v in reversed(list(enumerate(values[:-1]))):
        out = F.when(F.col("doc_id") % len(values) == i, F.lit(v)).otherwise(out)
    return F.replace(out, F.lit("{id}"), F.col("doc_id").cast("string"))


# Contracts


@query("""
    WITH e(k, id, subtask_type, input, expected_output, description) AS (VALUES
        (0, 5, 'reasoning', '"I"', '""', 'A #'), (0, 6, 'reasoning', 'null', '""', 'B'), (0, 7, 'code', '"I"', '{"f":1}', 'C'), (0, 8, 'reasoning', '"I"', '""', 'plain #'),
        (1, 3, 'reasoning', '""', '"E"', 'N'), (1, 4, 'reasoning', '""', '"E"', 'Subtask 4'),
        (2, 1, 'reasoning', '""', '""', 'T #'), (3, 1, 'reasoning', '""', '""', 'only #'))
    SELECT doc_id, CAST(id AS BIGINT) AS id, subtask_type, input, expected_output, replace(description, '#', CAST(doc_id AS VARCHAR)) AS description
    FROM documents JOIN e ON doc_id % 4 = k
""")
def subtasks(t):
    contract = chosen(
        '{"task_description":"T","input":"I","subtasks":[{"id":5,"description":" A {id} "},{"objective":"B","input":null,"subtask_type":" "},{"id":5.9,"task":"C","subtask_type":"code","expected_output":{"f":1}},"plain {id}"]}',
        '{"sub-tasks":[],"sub_tasks":{"a":{"id":"3","name":"N"},"b":{"id":"3.9"}},"expected_output":"E"}',
        '{"task_description":"T {id}","subtasks":[]}',
        '{"sub-tasks":"only {id}"}',
    )
    return records.subtasks(t("documents").select("doc_id"), "doc_id", contract)


@query("SELECT event_id, 'domain,topic' AS keys, event_type AS topic FROM events")
def declared_keys(t):
    m = F.create_map(F.lit("other"), F.lit("x"), F.lit("domain"), F.col("user_id").cast("string"), F.lit("topic"), F.col("event_type"))
    kept = records.kept_keys(m, ("topic", "domain", "constraints"))
    return t("events").select("event_id", F.array_join(F.array_sort(F.map_keys(kept)), ",").alias("keys"), F.element_at(kept, "topic").alias("topic"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source ELSE 'us' END AS region, lang, 'base' AS url FROM documents")
def settings_overlay(t):
    base = F.create_map(F.lit("region"), F.lit("us"), F.lit("lang"), F.lit("en"), F.lit("url"), F.lit("base"))
    file = F.create_map(F.lit("lang"), F.col("lang"), F.lit("url"), F.lit(None).cast("string"))
    env = F.when(F.col("doc_id") % 2 == 0, F.create_map(F.lit("region"), F.col("source")))
    m = records.overlaid(base, file, env)
    return t("documents").select("doc_id", *(F.element_at(m, k).alias(k) for k in ("region", "lang", "url")))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'base_url' WHEN 1 THEN 'api_key' ELSE '' END AS missing FROM documents")
def required_fields(t):
    k = F.col("doc_id") % 3
    m = F.create_map(F.lit("model"), F.lit("m"), F.lit("base_url"), F.when(k != 0, "u").otherwise(""), F.lit("api_key"), F.when(k != 1, "k"))
    return t("documents").select("doc_id", F.array_join(records.missing_fields(m, ("model", "base_url", "api_key")), ",").alias("missing"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'first' WHEN 1 THEN 'second ' || doc_id ELSE 'fallback' END AS description FROM documents")
def field_fallback(t):
    v = F.try_parse_json(chosen('{"description":" first ","subtask_description":"x"}', '{"description":"","subtask_description":"second {id}"}', '{"description":null}'))
    return t("documents").select("doc_id", records.field_or(v, "$.description", "$.subtask_description", default="fallback").alias("description"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 3 WHEN 1 THEN 12 ELSE NULL END::BIGINT AS n FROM documents")
def safe_whole(t):
    return t("documents").select("doc_id", records.whole_number(F.try_parse_json(chosen("3.9", '" 12 "', '"3.9"', '""'))).alias("n"))


@query("SELECT event_id, greatest(1, CAST(trunc(value) AS BIGINT) - 50) AS n FROM events")
def clamp_to_one(t):
    return t("events").select("event_id", records.at_least_one(F.col("value").cast("bigint") - 50).alias("n"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '{\"a\": \"x \\\\\\\\(y\\\\\\\\)\"}' WHEN 1 THEN 'after ' || doc_id WHEN 2 THEN 'none ' || doc_id ELSE '{\"n\":' || doc_id || '}' END AS answer FROM documents".replace("\\\\\\\\", "\\\\"))
def web_answer(t):
    x = chosen('so {"a": "x \\(y\\)"} ok', "<think>{bad</think> after {id}", "none {id}", 'is {"n":{id}}.')
    return t("documents").select("doc_id", records.web_answer(x).alias("answer"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '{\"n\":' || doc_id || '}' WHEN 1 THEN '[1]' WHEN 2 THEN NULL ELSE '{\"b\":2}' END AS parsed FROM documents")
def browser_json(t):
    return t("documents").select("doc_id", records.browser_json(chosen('{"n":{id}}', "x\n```json\n[1]\n```\n```\n[2]\n```", "none [3]", 'so {"b":2} ok')).alias("parsed"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '{\"a\":1}' WHEN 1 THEN '\"say \\\"hi\\\" ' || doc_id || '\"' ELSE '7' END AS item FROM documents")
def parsed_or_text(t):
    return t("documents").select("doc_id", F.to_json(records.parsed_or_text(chosen('{"a":1}', 'say "hi" {id}', "7"))).alias("item"))


# Nodes: an event is a node, a user a subtask


@query(f"""
    SELECT user_id AS subtask_id, 'd' || event_id AS description, event_type AS result, value AS reward, '' AS log_path
    FROM (SELECT *, {DECIDED} AS decision FROM events) WHERE decision = 'complete'
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) = 1
""")
def completed_subtasks(t):
    e = t("events").select(F.col("event_id").alias("node_id"), F.col("user_id").alias("subtask_id"), F.expr(DECIDED).alias("decision"), F.concat(F.lit("d"), "event_id").alias("description"), F.col("event_type").alias("result"), F.col("value").alias("reward"), F.lit(None).cast("string").alias("log_path"))
    return records.completed_subtasks(e)


@query("SELECT user_id AS subtask_id, row_number() OVER (ORDER BY user_id) AS pos FROM (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase')")
def completed_order(t):
    done = t("events").filter("event_type = 'purchase'").select(F.col("user_id").alias("subtask_id")).distinct()
    return selection.positions(done, "subtask_id")


@query("SELECT conv_id, turn AS node_id, turn + 1 AS depth, conv_id AS subtask_id, role AS node_type, text AS description, text AS result, text AS theoretician_output, '' AS log_path, CAST(0 AS DOUBLE) AS reward, '' AS memory FROM conversations")
def node_record(t):
    c = F.col
    node = records.node_record(c("turn"), c("conv_id"), c("role"), c("text"), c("text"), c("turn") + 1, F.lit(None).cast("string"))
    return t("conversations").select("conv_id", F.inline(F.array(node)))


SHORTENED = "CASE WHEN length(text) > {0} THEN left(text, {0} // 2) || chr(10) || '... [truncated] ...' || chr(10) || right(text, {0} // 2) ELSE coalesce(text, '') END"


@query(f"""
    SELECT doc_id AS node_id, doc_id - 1 AS parent_id, n_chars AS depth, 'draft' AS node_type, {SHORTENED.format(4000)} AS description, CAST(0 AS DOUBLE) AS reward, 1 AS visits, 'completed' AS status,
        'supervisor' AS created_by, '' AS memory, {SHORTENED.format(48000)} AS theoretician_output, CASE WHEN doc_id % 2 = 0 THEN lang ELSE '{{}}' END AS critic_feedback
    FROM documents
""")
def visual_nodes(t):
    none = F.lit(None).cast("string")
    d = t("documents").select(F.col("doc_id").alias("node_id"), (F.col("doc_id") - 1).alias("parent_id"), F.col("n_chars").alias("depth"), none.alias("node_type"), F.col("text").alias("description"), none.alias("reward"), none.alias("memory"), F.col("text").alias("theoretician_output"), F.lit("").alias("evaluation"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("critic_feedback"))
    return records.visual_nodes(d)


@query("""
    WITH n AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey DESC) AS pos FROM customer)
    SELECT o_orderkey AS parent_id, o_custkey AS child_id, a.pos AS source, b.pos AS target FROM orders JOIN n a ON o_orderkey = a.c_custkey JOIN n b ON o_custkey = b.c_custkey
""")
def indexed_edges(t):
    nodes = selection.positions(t("customer").select("c_custkey"), "c_custkey", descending=True)
    e = t("orders").select(F.col("o_orderkey").alias("parent_id"), F.col("o_custkey").alias("child_id"))
    return records.indexed_edges(e, nodes, "c_custkey", "pos")


@query("SELECT event_id, CASE WHEN value >= 0.85 THEN 'high' WHEN value >= 0.60 THEN 'middle' ELSE 'low' END AS band FROM events")
def reward_bands(t):
    return t("events").select("event_id", records.reward_band(F.col("value")).alias("band"))


@query("SELECT event_id, user_id FROM events WHERE event_id % 3 = 0")
def code_requests(t):
    e = t("events").select("event_id", "user_id", F.when(F.col("event_id") % 3 == 0, "print(1)").when(F.col("event_id") % 3 == 1, " \n\t").alias("code"))
    return records.with_code(e, "code").drop("code")


# Tools


@query("SELECT replace(p_type, ' ', '_') AS safe_name, max(p_brand) AS server, replace(p_type, ' ', '-') AS name FROM part GROUP BY p_type")
def tool_names(t):
    tools = t("part").select(F.col("p_brand").alias("server"), F.replace("p_type", F.lit(" "), F.lit("-")).alias("name"))
    return records.tool_names(tools)


@query("""
    WITH s AS (SELECT p_type, max(p_brand) AS server FROM part WHERE p_brand <> (SELECT min(p_brand) FROM part) OR p_type = (SELECT min(p_type) FROM part) GROUP BY p_type)
    SELECT p_partkey, server AS tool_server, replace(s.p_type, ' ', '-') AS tool_name, s.p_type IS NOT NULL AS known FROM part p LEFT JOIN s ON s.p_type = p.p_type AND p_partkey % 3 <> 0
""")
def tool_calls(t):
    part = t("part")
    low = part.agg(F.min("p_brand").alias("b"), F.min(F.replace("p_type", F.lit(" "), F.lit("-"))).alias("n")).first()
    tools = records.tool_names(part.select(F.col("p_brand").alias("server"), F.replace("p_type", F.lit(" "), F.lit("-")).alias("name")), server=low.b, allowed=(low.n,))
    asked = part.select("p_partkey", F.when(F.col("p_partkey") % 3 != 0, F.replace("p_type", F.lit(" "), F.lit("_"))).otherwise("no_such_tool").alias("called"))
    return records.calls(asked, tools, "called").drop("called")


@query("SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN text || '|' || role WHEN 1 THEN 'img|' || role WHEN 2 THEN 'res|' || role ELSE role END AS parts FROM conversations")
def content_parts(t):
    k = F.col("turn") % 4
    kind = F.when(k == 0, "text").when(k == 1, "image").when(k == 2, "resource").otherwise("audio")
    part = lambda kind, text: F.struct(kind.alias("type"), text.alias("text"), F.lit("img").alias("data"), F.lit("res").alias("resource"))
    return t("conversations").select("conv_id", "turn", F.array_join(records.content_parts(F.array(part(kind, F.col("text")), part(F.lit("text"), F.col("role")))), "|").alias("parts"))


@query("SELECT event_id, 'tool' AS main_stream_type, '' AS sub_stream_type, event_type AS content, true AS from_sandbox, 'running' AS stream_state, '{}' AS other_info FROM events")
def stream_items(t):
    return t("events").select("event_id", F.inline(F.array(records.stream_item(F.lit("tool"), F.col("event_type"), F.lit("running")))))


@query("SELECT user_id, event_id, CASE WHEN row_number() OVER w = 1 THEN 'start' WHEN row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1 THEN 'end' ELSE 'running' END AS stream_state FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def lifecycle(t):
    return sessions.lifecycle(t("events").select("user_id", "event_id"), "user_id", "event_id")


@query("SELECT user_id, min(event_id) AS created_by FROM events GROUP BY user_id")
def session_created(t):
    return records.first_seen(t("events"), "user_id", "event_id")


@query("SELECT event_id, event_type = 'purchase' AS terminal FROM events")
def terminal_events(t):
    sub = F.when(F.col("event_type") == "purchase", F.lit(None)).otherwise(F.col("event_type"))
    return t("events").select("event_id", J.is_terminal(sub, F.lit("end")).alias("terminal"))


@query("SELECT user_id, date_trunc('second', ts) AS second, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 0")
def over_rate(t):
    return sessions.over_rate(t("events"), "user_id", "ts", 0)


# Manifests and skills


@query("""
    SELECT doc_id, '- skill_id: ' || doc_id || chr(10) || '  domain: ' || lang || CASE WHEN g = '' THEN '' ELSE chr(10) || '  goal: ' || CASE WHEN length(g) > 240 THEN left(g, 237) || '...' ELSE g END END
        || CASE WHEN doc_id % 2 = 0 THEN chr(10) || '  scope:' || chr(10) || '    - ' || source || chr(10) || '    - b' ELSE '' END AS entry
    FROM (SELECT *, regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS g FROM documents)
""")
def manifest_lines(t):
    scope = F.when(F.col("doc_id") % 2 == 0, F.array(F.col("source"), F.lit("b")))
    return t("documents").select("doc_id", records.manifest_line(F.col("doc_id").cast("string"), F.col("lang"), F.col("text"), scope).alias("entry"))


@query("SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY lower(lang), doc_id) AS pos FROM documents")
def manifest_order(t):
    from pyspark.sql import Window as W

    return t("documents").select("doc_id", F.row_number().over(W.partitionBy("source").orderBy(F.lower("lang"), "doc_id")).cast("long").alias("pos"))


@query("SELECT source, doc_id FROM documents WHERE doc_id % 3 = 0 QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 10")
def first_bad_rows(t):
    bad = t("documents").select("source", "doc_id", F.when(F.col("doc_id") % 3 != 0, "x").alias("skill_id")).filter("skill_id is null")
    return selection.top_k_per_key(bad, "source", 10, "doc_id").drop("skill_id")


@query(r"""
    SELECT doc_id, '<SKILL_FULL>' || chr(10) || 'name: ' || doc_id || chr(10) || 'path: ' || source || chr(10) || '---' || chr(10) || regexp_replace(text, '^\s+|\s+$', '', 'g') || chr(10) || '</SKILL_FULL>' AS block FROM documents
""")
def skill_full(t):
    return t("documents").select("doc_id", records.skill_full(F.col("doc_id").cast("string"), F.col("source"), F.col("text")).alias("block"))


@query("SELECT source, string_agg('- ' || doc_id, chr(10) ORDER BY doc_id) AS scope FROM documents QUALIFY true GROUP BY source".replace(" QUALIFY true", "").replace("FROM documents", "FROM (SELECT * FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 6)"))
def scope_bullets(t):
    first = selection.top_k_per_key(t("documents").select("source", "doc_id"), "source", 6, "doc_id")
    rows = first.groupBy("source").agg(F.sort_array(F.collect_list("doc_id")).alias("d"))
    return rows.select("source", T.bullets(F.transform("d", lambda x: x.cast("string"))).alias("scope"))


@query("SELECT conv_id, string_agg(role, chr(10) ORDER BY turn) AS lines FROM conversations GROUP BY conv_id")
def listed_with_nulls(t):
    return formatting.listed(t("conversations"), "conv_id", "turn", F.col("role"), "lines", tie="role")
