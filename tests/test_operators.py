import os

from pyspark.sql import functions as F

from steplake.operators import formatting, matching, selection, trajectory
from steplake.plans import catalogue
from steplake.sources import files
from steplake.streaming import sessions


def test_chain(spark):
    rows = trajectory.chain(spark.createDataFrame([(1, 3), (1, 5), (1, 9), (2, 4)], "task long, node long"), "task", "node").orderBy("task", "node").collect()
    assert [r.parent_id for r in rows] == [None, 3, 5, None]
    assert [r.children for r in rows] == [[5], [9], [], []]
    assert [round(r.viz_y, 9) for r in rows] == [0.08, 0.5, 0.92, 0.5]


def test_id_repair(spark):
    df = spark.createDataFrame([([5, None, 6, 6, None],)], "ids array<long>")
    assert df.select(trajectory.repaired_ids(F.col("ids")).alias("r")).first().r == [5, 6, 7, 8, 9]


def test_best_prefers_first_of_ties_and_no_nan(spark):
    df = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.9), (1, 3, 0.9), (1, 4, float("nan"))], "k long, n long, v double")
    assert selection.best_per_group(df, "k", "v", "n").first().n == 2


def test_duplicates_and_missing(spark):
    df = spark.createDataFrame([("a", "p1"), ("a", "p2"), ("b", "p3")], "k string, p string")
    assert selection.duplicates(df, "k", "p").first() == ("a", 2, "p1", "p2")
    assert [r.k for r in selection.missing(spark.createDataFrame([("a",), ("z",)], "k string"), df, "k").collect()] == ["z"]


def test_match_thresholds(spark):
    q = spark.createDataFrame([(1, "alpha beta"), (2, "nothing here")], "q long, t string")
    g = spark.createDataFrame([(1, "alpha one two three"), (2, "alpha one"), (3, None)], "g long, t string")
    rows = matching.workflow_match(q, g, "q", "t", "g", "t").collect()
    assert [(r.q, r.g, r.overlap) for r in rows] == [(1, 2, 1)]  # 1 of 4 misses 0.34


def test_hits_slice_before_filter(spark):
    df = spark.createDataFrame([('{"organic":[1,{"title":"a"},{"title":"b"}]}',)], "r string")
    assert [h.title for h in df.select(formatting.hits(F.parse_json("r"), 2).alias("h")).first().h] == ["a"]
    assert df.select(formatting.parse_reply(F.parse_json(F.lit('"plain"'))).alias("p")).first().p.score == 0.5


def test_skill_files(spark, tmp_path):
    for n, text in (("a", "---\nname: one\n---\nsome text"), ("b", "# H\n\nbody")):
        os.makedirs(tmp_path / n)
        (tmp_path / n / "SKILL.md").write_text(text)
    (tmp_path / "w.yaml").write_text("Workflow:\n  Goal: fall freely\n")
    (tmp_path / "bad.yml").write_text("a: [")
    found = files.skills(spark, [f"file://{tmp_path}"])
    assert {(r.name, r.summary) for r in found.collect()} == {("one", "some text"), ("b", "body")}
    assert "- skill_name: b" in files.skill_brief(found).first().brief
    assert [r.goal for r in files.workflows(spark, f"file://{tmp_path}").collect()] == ["fall freely"]


def test_stream_ends_at_terminal_event(spark, tmp_path):
    item = '{{"session_id":"{0}","seq":{1},"sub_stream_type":"{2}","stream_state":"{3}"}}'
    lines = [item.format("s", 1, "", "start"), "bad", "", item.format("s", 2, "tool", "end"), item.format("s", 3, "", "end"), item.format("s", 4, "", "running"), item.format("t", 1, "", "running")]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.txt").write_text("\n".join(lines))
    rows = sessions.parsed_lines(spark.readStream.text(str(tmp_path / "in")))
    q = sessions.until_end(rows.filter("error is null").drop("error")).writeStream.format("memory").queryName("ended").outputMode("append").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert {(r.session_id, r.seq) for r in spark.table("ended").collect()} == {("s", 1), ("s", 2), ("s", 3), ("t", 1)}


def test_whole_texts(spark, tmp_path):
    """The queries over whole texts lose nothing after their first characters."""
    texts = ["x" * 70 + " a/b\n</think> tail " + "y" * 50, "short", "z" * 100 + "é?*"]
    spark.createDataFrame([(1, i, "user", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {n: sorted(map(tuple, catalogue.QUERIES[f"{n}_whole"](spark, str(tmp_path)).collect())) for n in ("running_memory", "sanitize_name", "template_fill", "after_think", "format_results")}
    assert got["running_memory"] == [(1, i, "\n".join(texts[:i])) for i in range(3)]
    assert got["sanitize_name"] == [(i, "".join(c if c.isalnum() or c in "._-" else "_" for c in t)) for i, t in enumerate(texts)]
    assert got["template_fill"] == [(1, i, f"Task 1 by user: {t}") for i, t in enumerate(texts)]
    assert got["after_think"] == [(1, i, t.split("</think>")[-1].strip()) for i, t in enumerate(texts)]
    assert got["format_results"] == [(1, "\n".join(f"{i + 1}. user\nURL: {i}\n{t}" for i, t in enumerate(texts)))]


def test_positions(spark):
    keys = [None, None, *(i * 37 % 101 for i in range(300))]
    df = spark.createDataFrame([(k, i, "x") for i, k in enumerate(keys)], "k long, n long, _of string").repartition(5)
    up = sorted(range(len(keys)), key=lambda i: (keys[i] is not None, keys[i] or 0, i))
    down = sorted(range(len(keys)), key=lambda i: (keys[i] is None, -(keys[i] or 0), i))
    for descending, want in ((False, up), (True, down)):
        got = selection.positions(df, "k", "pos", descending, "n")
        assert got.columns == ["k", "n", "_of", "pos"]
        assert {r.n: r.pos for r in got.collect()} == {i: p + 1 for p, i in enumerate(want)}
    assert selection.positions(df.filter("false"), "k").count() == 0
    assert [r.pos for r in selection.positions(df.filter("k is null"), "k", "pos", False, "n").orderBy("n").collect()] == [1, 2]
