import json
import os

import pytest
from pyspark.sql import functions as F

from steplake.functions import registry
from steplake.functions import text as T
from steplake.operators import formatting, matching, records, selection, trajectory
from steplake.sources import files
from steplake.streaming import sessions


def test_entries_without_text_stay(spark):
    df = spark.createDataFrame([(1, 1, "a", "x"), (1, 2, None, "y"), (1, 3, "c", "z")], "k long, o long, t string, u string")
    assert formatting.numbered(df, "k", "o", F.col("t"), "r").first().r == "1. a\n2. \n3. c"
    assert formatting.listed(df, "k", "o", F.col("t"), "r", tie="u").first().r == "a\n\nc"
    urls = F.array(F.struct(F.lit("u").alias("url"), F.lit(None).cast("string").alias("description")))
    assert df.select(formatting.parsed_block(F.lit(None).cast("double"), F.lit("c"), urls).alias("b")).first().b == "score: \nc\nrelated_urls:\n- u: "


def test_text_ids_and_clashing_columns(spark):
    q = spark.createDataFrame([(1, "alpha beta")], "word long, t string")
    g = spark.createDataFrame([("b/x.yaml", "alpha beta"), ("a/x.yaml", "alpha beta")], "size string, t string")
    assert matching.workflow_match(q, g, "word", "t", "size", "t").first()[:2] == (1, "a/x.yaml")
    df = spark.createDataFrame([(1, "a", 7, True), (1, "b", 8, False)], "k long, v string, _n long, _done boolean")
    assert selection.best_per_group(df, "k", "v", "_n").first().v == "b"
    assert selection.top_k_per_key(df, "k", 1, "v").first() == (1, "a", 7, True)
    assert trajectory.until_terminal(df, "k", "v", F.col("v") == "a").columns == df.columns


def test_subtasks(spark):
    rows = [(1, '{"input": {"f": 1}, "subtasks": [{"id": 5}, {"input": null, "name": " n "}, {"id": 6}, {"id": "6"}, "text", {"id": "x"}]}'), (2, None), (3, "[1]"), (4, '{"sub_tasks": 3, "task_description": "d"}')]
    got = {}
    for r in records.subtasks(spark.createDataFrame(rows, "k long, c string"), "k", F.col("c")).orderBy("k", "id").collect():
        got.setdefault(r.k, []).append((r.id, r.input, r.description))
    assert got[1] == [(5, '{"f":1}', "Subtask 5"), (6, "null", "n"), (7, '{"f":1}', "Subtask 7"), (8, '{"f":1}', "Subtask 8"), (9, '{"f":1}', "text"), (10, '{"f":1}', "Subtask 10")]
    assert got[2] == got[3] == [(1, '""', "Subtask 1")] and got[4] == [(1, '""', "d")]


def test_fetch_rules(spark):
    rows = [("a.PDF", "x", "y"), ("b", "", "fallback"), ("c", "%PDF-1", None), ("d", "Failed to fetch is a phrase", None), ("e", "so: Failed to fetch web page", None), ("f", None, None)]
    df = spark.createDataFrame(rows, "link string, body string, fallback string")
    got = {r.link: (r.f.ok, r.f.text) for r in df.select("link", files.fetched(F.col("link"), F.col("body"), F.col("fallback")).alias("f")).collect()}
    assert got == {"a.PDF": (False, ""), "b": (True, "fallback"), "c": (False, ""), "d": (True, "Failed to fetch is a phrase"), "e": (False, ""), "f": (False, "")}
    big = df.limit(1).select(F.length(files.capped(F.repeat(F.lit("ab"), 2 << 20))).alias("n"), files.first_fetched(F.lit(""), F.lit("d")).alias("t")).first()
    assert big.n == files.READ_CAP and big.t == "d"


def test_manifests_and_skills(spark, tmp_path):
    for n, text in (("a", "skill_id: Beta\ndomain: z\ngoal: |\n  one\n  two\nscope: [x, y]"), ("b", "skill_id: alpha\ndomain: Z\nscope: s")):
        os.makedirs(tmp_path / "m" / n)
        (tmp_path / "m" / n / "skill.yaml").write_text(text)
        (tmp_path / "m" / n / "SKILL.md").write_text(f"---\nname: {n}\n---\nbody {n}")
    found = files.manifests(spark, f"file://{tmp_path}/m")
    files.write_manifest_text(found, f"{tmp_path}/text")
    text = "".join(p.read_text() for p in (tmp_path / "text").glob("part*"))
    assert text == "- skill_id: alpha\n  domain: Z\n  scope:\n    - s\n\n- skill_id: Beta\n  domain: z\n  goal: one two\n  scope:\n    - x\n    - y\n\n"
    (tmp_path / "m" / "c").mkdir()
    (tmp_path / "m" / "c" / "skill.yaml").write_text("skill_id: Beta")
    with pytest.raises(ValueError, match="several manifests: Beta"):
        files.manifests(spark, f"file://{tmp_path}/m")
    (tmp_path / "m" / "c" / "skill.yaml").write_text("domain: x")
    with pytest.raises(ValueError, match="c/skill.yaml"):
        files.manifests(spark, f"file://{tmp_path}/m")
    skills = files.skills(spark, [f"file://{tmp_path}/m"])
    blocks = [r.block for r in files.skill_specs(skills, spark, ["b", "a", "b"]).collect()]
    assert [b.split("\n")[1] for b in blocks] == ["name: b", "name: a", "name: b"] and "body a" in blocks[1]
    with pytest.raises(ValueError, match="no such skills: q, z"):
        files.skill_specs(skills, spark, ["z", "a", "q"])
    assert files.single_workflow(spark, f"file://{tmp_path}/none.yaml").count() == 0
    (tmp_path / "w.yaml").write_text("workflow: {goal: fall}")
    assert files.single_workflow(spark, f"file://{tmp_path}/w.yaml").first().goal == "fall"
    (tmp_path / "d.json").write_text('{\n "a": 1\n}')
    assert files.json_document(spark, f"file://{tmp_path}/d.json").first().a == 1


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("t", 1, "é")], "task string, node long, x string")
    files.write_json(df, f"{tmp_path}/j", "task", "node")
    assert json.loads(next((tmp_path / "j" / "task=t" / "node=1").glob("part*")).read_text()) == {"x": "é"}
    files.write_html(df, "<p>@@</p>", "@@", f"{tmp_path}/h")
    assert "".join(p.read_text() for p in (tmp_path / "h").glob("part*")).strip() == '<p>[{"task":"t","node":1,"x":"é"}]</p>'
    files.write_markdown(spark.createDataFrame([("# a\n\n",)], "m string"), "m", f"{tmp_path}/md")
    assert "".join(p.read_text() for p in (tmp_path / "md").glob("part*")) == "# a\n"


def test_token_chunks(spark):
    places = pytest.importorskip("public_tokenizers")
    text = "one two three four five " * 50
    df = spark.createDataFrame([(text,), (None,), ("",)], "t string")
    got = [r.c for r in df.select(T.token_chunks(places.path("byte_bpe_50k.json"), 20)(F.col("t")).alias("c")).collect()]
    assert "".join(got[0]) == text and len(got[0]) > 5 and got[1:] == [[], []]
    assert df.select(T.token_chunks("/none", 20)(F.col("t")).alias("c")).first().c == [text]


def test_functions_by_schema(spark):
    registry.register(spark)
    schema = {"properties": {"overlap": {"type": "integer"}, "words": {"type": "integer", "default": 4}}, "required": ["overlap"]}
    assert spark.range(1).select(registry.call("match_score", schema, {"overlap": F.lit(2)}).alias("s")).first().s == 4.5
    with pytest.raises(ValueError, match="overlap"):
        registry.call("match_score", schema, {})
    assert "match_score" in {r.name for r in registry.session_functions(spark).collect()}


def test_stream_goes_on_after_a_restart_and_a_reset(spark, tmp_path):
    item = "session_id string, seq long, main_stream_type string, sub_stream_type string, content string, stream_state string, from_sandbox boolean"
    put = lambda *rows: sessions.append_items(spark.createDataFrame([("s", n, kind, "", "c", state, True) for n, kind, state in rows], item), f"{tmp_path}/in")

    def run():
        rows = sessions.parsed_lines(spark.readStream.text(f"{tmp_path}/in"))
        q = sessions.respond(sessions.until_end(rows.filter("error is null").drop("error")), f"{tmp_path}/out", f"{tmp_path}/ck")
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        return sorted(r.seq for r in spark.read.json(f"{tmp_path}/out").select("seq").collect())

    put((1, "tool", "start"), (2, "tool", "end"), (3, "tool", "running"))
    assert run() == [1, 2]
    put((4, "tool", "running"))
    assert run() == [1, 2]
    put((5, "reset", "running"), (6, "tool", "start"))
    assert run() == [1, 2, 6]


def test_routes_and_rates(spark):
    df = spark.createDataFrame([("abc",), (None,)], "s string")
    got = sorted((r.s or "", r.worker) for r in sessions.routed(df, "s", 7).collect())
    assert got[1] == ("abc", 0) and 0 <= got[0][1] < 7
    assert spark.range(1).select(T.bullets(F.array(F.lit("a"), F.lit("b")), 1).alias("b")).first().b == "- a"
