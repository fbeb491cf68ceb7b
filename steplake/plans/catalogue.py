"""All queries of the library, with equivalent SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import loose as J
from ..functions import text as T
from ..operators import formatting, matching, selection, trajectory
from ..streaming import sessions

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Callable], Callable]:
    """Register a function of a table reader; ``sql`` is its equivalent."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


STOP = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"
TOKENS = r"regexp_extract_all(lower(regexp_replace({0}, '^\s+|\s+$', '', 'g')), '([a-z0-9_]+|[\x{{4e00}}-\x{{9fff}}]+)', 1)"


def sql_tokens(column: str) -> str:
    return f"list_filter({TOKENS.format(column)}, lambda t: NOT list_contains({STOP}, t))"


# Matching


@query(f"""
    WITH q AS (SELECT doc_id, unnest(list_distinct({sql_tokens('text')})) AS word FROM documents),
    g0 AS (SELECT item_id, {sql_tokens('text')} AS words FROM benchmark),
    g AS (SELECT item_id, len(words) AS size, unnest(list_distinct(words)) AS word FROM g0),
    m AS (SELECT doc_id, item_id, size, count(*) AS overlap FROM q JOIN g USING (word) GROUP BY ALL),
    s AS (SELECT *, overlap / greatest(size, 1) AS ratio FROM m)
    SELECT doc_id, item_id, overlap, ratio, 2 * overlap + ratio AS score FROM s
    WHERE ratio >= CASE WHEN size >= 5 THEN 0.25 ELSE 0.34 END
    QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY 2 * overlap + ratio DESC, item_id) = 1
""")
def workflow_match(t):
    return matching.workflow_match(t("documents"), t("benchmark"), "doc_id", "text", "item_id", "text")


@query(f"SELECT doc_id, array_to_string({sql_tokens('text')}, ' ') AS words, len({TOKENS.format('text')}) AS n_tokens FROM documents")
def stopword_tokens(t):
    c = F.col("text")
    return t("documents").select("doc_id", F.array_join(T.content_tokens(c), " ").alias("words"), F.size(T.tokens(c)).cast("long").alias("n_tokens"))


# Trajectories: a conversation is a task, its turns are steps


@query("""
    SELECT conv_id, turn, lag(turn) OVER w AS parent_id,
        coalesce(CAST(lead(turn) OVER w AS VARCHAR), '') AS children, row_number() OVER w - 1 AS depth,
        first_value(turn) OVER w AS root_id, CAST(0.5 AS DOUBLE) AS viz_x,
        CASE WHEN count(*) OVER (PARTITION BY conv_id) = 1 THEN CAST(0.5 AS DOUBLE)
            ELSE CAST(0.08 AS DOUBLE) + CAST(0.84 AS DOUBLE) * percent_rank() OVER w END AS viz_y
    FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
""")
def chain_nodes(t):
    c = trajectory.chain(t("conversations").select("conv_id", "turn"), "conv_id", "turn")
    return c.withColumn("children", F.array_join(F.col("children").cast("array<string>"), ","))


@query("SELECT * FROM (SELECT conv_id, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS parent_id, turn AS child_id FROM conversations) WHERE parent_id IS NOT NULL")
def chain_edges(t):
    return trajectory.edges(t("conversations"), "conv_id", "turn")


@query("""
    WITH e AS (SELECT o_orderkey AS parent_id, o_custkey AS child_id FROM orders)
    SELECT * FROM e WHERE parent_id IN (SELECT c_custkey FROM customer) AND child_id IN (SELECT c_custkey FROM customer)
""")
def valid_edges(t):
    e = t("orders").select(F.col("o_orderkey").alias("parent_id"), F.col("o_custkey").alias("child_id"))
    return trajectory.valid_edges(e, t("customer"), "c_custkey")


@query("""
    SELECT conv_id, turn, turn % 3 AS depth,
        row_number() OVER (PARTITION BY conv_id, turn % 3 ORDER BY turn) / (count(*) OVER (PARTITION BY conv_id, turn % 3) + 1) AS x,
        CAST(0.12 AS DOUBLE) + CAST(0.16 AS DOUBLE) * (turn % 3) AS y
    FROM conversations
""")
def depth_layout(t):
    c = t("conversations").select("conv_id", "turn", (F.col("turn") % 3).alias("depth"))
    return trajectory.depth_layout(c, "conv_id", "depth", "turn")


@query("""
    SELECT conv_id, turn, coalesce(string_agg(nullif(text, ''), chr(10) ORDER BY turn) OVER (
        PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS memory
    FROM conversations
""")
def running_memory_whole(t):
    return t("conversations").select("conv_id", "turn", trajectory.running_memory(F.col("text"), "conv_id", "turn").alias("memory"))


DECIDED = "CASE event_type WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'to_redraft' ELSE 'to_revise' END"


@query(f"""
    WITH e AS (SELECT event_id, user_id, {DECIDED} AS decision FROM events)
    SELECT event_id, decision, CASE WHEN lag(decision) OVER w IS NULL OR lag(decision) OVER w = 'to_redraft' THEN 'draft' ELSE 'revise' END AS node_type
    FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id)
""")
def node_type_transition(t):
    e = t("events").withColumn("decision", F.expr(DECIDED))
    return e.select("event_id", "decision", trajectory.node_type(F.col("decision"), "user_id", "event_id").alias("node_type"))


@query("SELECT conv_id, turn, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS previous FROM conversations")
def previous_result(t):
    from pyspark.sql import Window as W

    return t("conversations").select("conv_id", "turn", F.lag("text").over(W.partitionBy("conv_id").orderBy("turn")).alias("previous"))


@query("SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant' AND trim(text) <> '' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1")
def last_assistant_message(t):
    c = t("conversations").filter("role = 'assistant' and trim(text) <> ''")
    return c.groupBy("conv_id").agg(F.max_by(F.struct("turn", "text"), "turn").alias("m")).select("conv_id", "m.turn", "m.text")


@query("SELECT conv_id, max(turn) AS max_depth, count(*) AS rounds FROM conversations GROUP BY conv_id")
def rounds_and_depth(t):
    return t("conversations").groupBy("conv_id").agg(F.max("turn").alias("max_depth"), F.count("*").alias("rounds"))


@query("""
    WITH RECURSIVE s AS (
        SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pos,
            CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 7 END AS id FROM events
    ), r AS (
        SELECT user_id, pos, coalesce(id, 1) AS fixed, [coalesce(id, 1)] AS used, greatest(1, coalesce(id, 1) + 1) AS nxt FROM s WHERE pos = 1
        UNION ALL
        SELECT s.user_id, s.pos, f.v, list_append(r.used, f.v), greatest(r.nxt, f.v + 1)
        FROM r JOIN s ON s.user_id = r.user_id AND s.pos = r.pos + 1,
            LATERAL (SELECT CASE WHEN s.id IS NULL OR list_contains(r.used, s.id) THEN r.nxt ELSE s.id END AS v) f
    ) SELECT user_id, pos, fixed FROM r
""")
def id_repair(t):
    rows = t("events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id", F.when(F.col("event_id") % 5 != 0, F.col("event_id") % 7).alias("id")))).alias("r"))
    ids = trajectory.repaired_ids(F.transform("r", lambda x: x["id"]))
    return rows.select("user_id", F.posexplode(ids).alias("p", "fixed")).select("user_id", (F.col("p") + 1).cast("long").alias("pos"), "fixed")


# Selection


@query("SELECT user_id, event_id, value FROM events WHERE event_type = 'purchase' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) = 1")
def best_per_group(t):
    return selection.best_per_group(t("events").filter("event_type = 'purchase'").select("user_id", "event_id", "value"), "user_id", "value", "event_id")


@query("SELECT source, doc_id, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) <= 5")
def top_k_per_key(t):
    return selection.top_k_per_key(t("documents").select("source", "doc_id", "n_chars"), "source", 5, F.desc("n_chars"), "doc_id")


@query("SELECT n_chars, doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY n_chars ORDER BY doc_id) = 1")
def first_wins_dedup(t):
    return selection.first_wins(t("documents").select("n_chars", "doc_id", "source"), "n_chars", "doc_id")


@query("""
    SELECT md5(text) AS k, count(*) AS n, min(doc_id) AS first_path,
        array_to_string(list_sort(list(doc_id))[2:], ',') AS later
    FROM documents GROUP BY text HAVING count(*) > 1
""")
def duplicate_report(t):
    return selection.duplicates(t("documents").select(F.md5(F.col("text").cast("binary")).alias("k"), "doc_id"), "k", "doc_id")


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT doc_id FROM labels)")
def missing_names(t):
    return selection.missing(t("orders").select("o_custkey").distinct(), t("labels").select(F.col("doc_id").alias("o_custkey")), "o_custkey")


@query("""
    WITH a AS (SELECT quality, doc_id FROM labels QUALIFY row_number() OVER (PARTITION BY quality ORDER BY doc_id) = 1)
    SELECT quality, conv_id * 100 + turn AS pos, doc_id FROM (SELECT conv_id, turn, CAST(turn % 3 AS INT) AS quality FROM conversations) JOIN a USING (quality)
""")
def requested_order_join(t):
    req = t("conversations").select((F.col("turn") % 3).cast("int").alias("quality"), (F.col("conv_id") * 100 + F.col("turn")).alias("pos"))
    return selection.in_requested_order(req, t("labels").select("quality", "doc_id"), "quality", "pos", "doc_id")


@query("SELECT doc_id, quality, toxic FROM labels WHERE quality = 1 AND toxic = 0")
def complete_only(t):
    return t("labels").filter("quality = 1 and toxic = 0").select("doc_id", "quality", "toxic")


# Text


@query(r"SELECT doc_id, CASE WHEN length(text) > 400 THEN left(text, 200) || chr(10) || '... [truncated] ...' || chr(10) || right(text, 200) ELSE text END AS short FROM documents")
def safe_short(t):
    return t("documents").select("doc_id", T.safe_short(F.col("text"), 400).alias("short"))


@query(r"""
    WITH p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n'),
        lambda x: regexp_replace(regexp_replace(x, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')), lambda x: x <> '' AND NOT starts_with(x, '#'))[1] AS f FROM documents)
    SELECT doc_id, coalesce(left(f, 280) || CASE WHEN length(f) > 280 THEN '...' ELSE '' END, '') AS summary FROM p
""")
def first_paragraph(t):
    return t("documents").select("doc_id", T.first_paragraph(F.col("text")).alias("summary"))


@query(r"SELECT doc_id, regexp_replace(text, '[^\p{L}\p{N}._-]', '_', 'g') AS name FROM documents")
def sanitize_name_whole(t):
    return t("documents").select("doc_id", T.sanitized(F.col("text")).alias("name"))


@query(r"""
    WITH o AS (SELECT doc_id, regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS l FROM documents)
    SELECT doc_id, CASE WHEN length(l) > 240 THEN left(l, 237) || '...' ELSE l END AS line FROM o
""")
def one_line(t):
    return t("documents").select("doc_id", T.one_line(F.col("text")).alias("line"))


@query("SELECT doc_id, i AS pos, substr(text, i * 2000 + 1, 2000) AS chunk FROM (SELECT doc_id, text, unnest(range(CAST(ceil(length(text) / 2000) AS BIGINT))) AS i FROM documents)")
def char_chunks(t):
    return t("documents").select("doc_id", F.posexplode(T.chunks(F.col("text"), 2000)).alias("pos", "chunk")).withColumn("pos", F.col("pos").cast("long"))


@query("SELECT doc_id, left(text, 20000) AS chunk FROM documents WHERE text <> ''")
def first_chunk(t):
    return t("documents").select("doc_id", F.get(T.chunks(F.col("text")), F.lit(0)).alias("chunk")).filter("chunk is not null")


@query("SELECT doc_id, CASE WHEN source LIKE '%src1%' THEN 6000 WHEN source LIKE '%src2%' THEN 12000 ELSE 8000 END AS tokens FROM documents")
def chunk_budget(t):
    model = F.replace(F.replace(F.col("source"), F.lit("src1"), F.lit("QWEN-")), F.lit("src2"), F.lit("DeepSeek-"))
    return t("documents").select("doc_id", T.chunk_tokens(model).alias("tokens"))


@query("SELECT conv_id, turn, 'Task ' || conv_id || ' by ' || role || ': ' || text AS prompt FROM conversations")
def template_fill_whole(t):
    return t("conversations").select("conv_id", "turn", T.fill("Task {id} by {who}: {text}", id=F.col("conv_id"), who=F.col("role"), text=F.col("text")).alias("prompt"))


@query(r"SELECT conv_id, turn, regexp_replace(list_extract(string_split('<think>' || text || '</think> ' || text, '</think>'), -1), '^\s+|\s+$', '', 'g') AS answer FROM conversations")
def after_think_whole(t):
    x = F.concat(F.lit("<think>"), "text", F.lit("</think> "), "text")
    return t("conversations").select("conv_id", "turn", T.after_think(x).alias("answer"))


# JSON and decisions


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def props_extract(t):
    return t("events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CASE event_id % 4 WHEN 3 THEN 0 ELSE 1 END AS found FROM (SELECT event_id, CASE event_id % 4 WHEN 3 THEN '{}' ELSE props END AS props FROM events)")
def lenient_json(t):
    wrapped = F.expr("CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN concat('so:\n```json\n', props, '\n```\nok') WHEN 2 THEN concat('it is ', props, ' then') ELSE 'none' END")
    e = t("events").select("event_id", J.lenient_json(wrapped).alias("j"))
    return e.select("event_id", F.try_variant_get(F.try_parse_json("j"), "$.k", "bigint").alias("k"), (F.col("j") != "{}").cast("int").alias("found"))


@query(f"""
    WITH e AS (SELECT event_id, {DECIDED} AS d FROM events)
    SELECT event_id, d AS decision, CASE d WHEN 'complete' THEN 'accept' WHEN 'to_redraft' THEN 'reject' ELSE 'refine' END AS verdict FROM e
""")
def decision_ladder(t):
    raw = F.expr("CASE event_type WHEN 'purchase' THEN ' Complete ' WHEN 'error' THEN 'TO_REDRAFT' WHEN 'view' THEN NULL ELSE event_type END")
    e = t("events").select("event_id", J.decision(raw).alias("decision"))
    return e.withColumn("verdict", J.verdict(F.lit(""), F.col("decision")))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0.0::DOUBLE ELSE CAST(CAST(value AS VARCHAR) AS DOUBLE) END AS reward FROM events")
def reward_cast(t):
    return t("events").select("event_id", J.reward(F.when(F.col("event_id") % 3 == 0, "high").otherwise(F.col("value").cast("string"))).alias("reward"))


@query("SELECT event_id, 'k: ' || json_extract_string(props, '$.k') || '; type: ' || event_type AS natural FROM events")
def natural_text(t):
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return t("events").select("event_id", J.natural_text(F.to_json(F.struct(k.alias("k"), F.col("event_type").alias("type")))).alias("natural"))


# Formatting


@query("""
    SELECT conv_id, string_agg(n || '. ' || role || chr(10) || 'URL: ' || turn || chr(10) || text, chr(10) ORDER BY turn) AS results
    FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) GROUP BY conv_id
""")
def format_results_whole(t):
    body = F.concat("role", F.lit("\nURL: "), F.col("turn").cast("string"), F.lit("\n"), "text")
    return formatting.numbered(t("conversations"), "conv_id", "turn", body, "results")


@query("SELECT conv_id, string_agg(n || '. node=' || turn || ' subtask=' || conv_id || ' reward=' || length(text), chr(10) ORDER BY turn) AS summary FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) GROUP BY conv_id")
def fallback_summary(t):
    body = F.format_string("node=%s subtask=%s reward=%s", "turn", "conv_id", F.length("text"))
    return formatting.numbered(t("conversations"), "conv_id", "turn", body, "summary")


@query("SELECT source, string_agg('- skill_name: ' || doc_id || chr(10) || '  path: ' || lang, chr(10) ORDER BY doc_id) AS brief FROM documents GROUP BY source")
def skill_brief(t):
    return formatting.listed(t("documents"), "source", "doc_id", F.concat(F.lit("- skill_name: "), F.col("doc_id").cast("string"), F.lit("\n  path: "), "lang"), "brief")


@query("SELECT page_id, 'score: ' || page_id || chr(10) || url || chr(10) || 'related_urls:' || chr(10) || '- ' || url || ': page' AS block FROM pages")
def format_parsed(t):
    urls = F.array(F.struct(F.col("url").alias("url"), F.lit("page").alias("description")))
    return t("pages").select("page_id", formatting.parsed_block(F.col("page_id"), F.col("url"), urls).alias("block"))


# Pages


@query("SELECT page_id, contains(url, '.pdf') OR contains(url, 'arxiv.org/abs/') OR contains(url, 'arxiv.org/pdf/') AS pdf, regexp_replace(url, '/+$', '') AS url FROM pages")
def url_route(t):
    return t("pages").select("page_id", T.is_pdf(F.col("url")).alias("pdf"), T.no_trailing_slash(F.col("url")).alias("url"))


@query("SELECT page_id, 'https://arxiv.org/pdf/' || page_id || '.pdf' AS url FROM pages")
def arxiv_rewrite(t):
    return t("pages").select("page_id", T.pdf_url(F.concat(F.lit("http://arxiv.org/abs/"), F.col("page_id").cast("string"))).alias("url"))


@query()
def html_text(t):
    return t("pages").select("page_id", T.html_to_text(F.col("html")).alias("text"))


@query()
def page_chunks(t):
    text = t("pages").select("page_id", T.html_to_text(F.col("html")).alias("text"))
    return text.select("page_id", F.posexplode(T.chunks(F.col("text"), 1000)).alias("pos", "chunk"))


# Sessions


@query("SELECT doc_id, CAST(('0x' || md5(source || doc_id))::UHUGEINT % 7 AS INT) AS worker FROM documents")
def md5_route(t):
    return t("documents").select("doc_id", J.md5_route(F.concat("source", F.col("doc_id").cast("string")), 7).alias("worker"))


@query("SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 2")
def rate_over_limit(t):
    w = F.window("ts", "1 hour")
    return t("events").groupBy("event_type", w.alias("w")).agg(F.count("*").alias("n")).filter("n > 2").select("event_type", F.col("w.start").alias("hour"), "n")


@query("""
    SELECT event_id, user_id, event_type FROM events
    QUALIFY coalesce(count(*) FILTER (WHERE event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0
""")
def until_terminal(t):
    e = t("events").select("event_id", "user_id", "event_type")
    return trajectory.until_terminal(e, "user_id", "event_id", F.col("event_type") == "purchase")


@query("SELECT count(*) FILTER (WHERE event_id % 10 <> 0) AS processed, count(*) FILTER (WHERE event_id % 10 = 0) AS errors FROM events")
def ndjson_ingest(t):
    good = F.to_json(F.struct(F.col("user_id").cast("string").alias("session_id"), F.col("event_id").alias("seq")))
    lines = t("events").select(F.when(F.col("event_id") % 10 == 0, "{bad").otherwise(good).alias("value"))
    rows = sessions.parsed_lines(lines)
    return rows.agg(F.count(F.when(F.col("error").isNull(), 1)).alias("processed"), F.count("error").alias("errors"))


# Further lookups and lists


@query("SELECT event_id, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY event_id)) AS micros FROM events")
def elapsed_micros(t):
    from pyspark.sql import Window as W

    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return t("events").select("event_id", (micros - F.lag(micros).over(W.partitionBy("user_id").orderBy("event_id"))).alias("micros"))


@query("SELECT d.doc_id, coalesce(l.quality, 0.5) AS x, coalesce(l.toxic, 0.5) AS y FROM documents d LEFT JOIN (SELECT DISTINCT doc_id, quality::DOUBLE AS quality, toxic::DOUBLE AS toxic FROM labels) l USING (doc_id)")
def place_or_default(t):
    have = t("labels").select("doc_id", F.col("quality").cast("double"), F.col("toxic").cast("double")).distinct()
    return t("documents").select("doc_id").join(have, "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(0.5)).alias("x"), F.coalesce("toxic", F.lit(0.5)).alias("y"))


@query("SELECT conv_id, string_agg(trim(text), chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def page_concat(t):
    return formatting.listed(t("conversations"), "conv_id", "turn", F.trim("text"), "text")


@query("SELECT c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY lower(c_name), c_custkey) AS pos FROM customer")
def sorted_by_lower_name(t):
    from pyspark.sql import Window as W

    return t("customer").select("c_custkey", F.row_number().over(W.partitionBy("c_mktsegment").orderBy(F.lower("c_name"), "c_custkey")).cast("long").alias("pos"))


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN text WHEN turn % 3 = 1 THEN role ELSE 'none' END AS analysis FROM conversations")
def first_filled(t):
    c = F.col("turn") % 3
    return t("conversations").select("conv_id", "turn", J.first_text(F.when(c == 0, F.col("text")), F.when(c == 1, F.col("role")).otherwise(""), F.lit("none")).alias("analysis"))


@query("SELECT page_id, regexp_replace(list_extract(string_split(url, '/'), -1), '(.)\\.[^.]*$', '\\1') AS stem FROM pages")
def path_stem(t):
    return t("pages").select("page_id", T.stem(F.col("url")).alias("stem"))


@query("SELECT doc_id, replace(replace('a ' || chr(92) || '(' || lang || chr(92) || ')', chr(92) || '(', chr(92) || chr(92) || '('), chr(92) || ')', chr(92) || chr(92) || ')') AS repaired FROM documents")
def latex_repair(t):
    return t("documents").select("doc_id", T.doubled_parens(F.concat(F.lit("a \\("), "lang", F.lit("\\)"))).alias("repaired"))


@query("SELECT event_id, event_type LIKE '%w%' OR event_type LIKE '%a%' OR event_type LIKE '%+%' AS blocked FROM events")
def write_mode_guard(t):
    return t("events").select("event_id", J.blocked_mode(F.col("event_type")).alias("blocked"))


from . import runs  # noqa: E402, F401  (registers its queries)
