from pyspark.sql import functions as F

from steplake.functions import loose as J
from steplake.functions import registry
from steplake.functions import text as T


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(f(F.col("c")).alias("r")).first().r


def test_tokens_and_stop_words(spark):
    assert one(spark, "\tThe quick_1 量子 TASK a", T.tokens) == ["the", "quick_1", "量子", "task", "a"]
    assert one(spark, "b the b", T.content_tokens) == ["b", "b"]
    assert one(spark, None, T.content_tokens) == []


def test_safe_short(spark):
    assert one(spark, "abcd", lambda c: T.safe_short(c, 4)) == "abcd"
    assert one(spark, "abcde", lambda c: T.safe_short(c, 4)) == "ab" + T.CUT_MARK + "de"
    assert one(spark, "abc", lambda c: T.safe_short(c, 1)) == "a" + T.CUT_MARK + "c"
    assert one(spark, None, lambda c: T.safe_short(c, 4)) == ""


def test_front_matter(spark):
    doc = "---\nname: x\ndescription: 'y: z'\n---\n# Head\n\nfirst  \n line\n\nnext"
    assert one(spark, doc, T.front_matter) == {"name": "x", "description": "y: z"}
    assert one(spark, doc, T.first_paragraph) == "first line"
    assert one(spark, "a" * 281, T.first_paragraph) == "a" * 280 + "..."
    assert one(spark, "no block", T.front_matter) == {}


def test_chunks(spark):
    assert one(spark, "", lambda c: T.chunks(c, 3)) == []
    assert one(spark, "äbcdef", lambda c: T.chunks(c, 3)) == ["äbc", "def"]
    assert one(spark, "My-DeepSeek", T.chunk_tokens) == 12000


def test_urls_and_names(spark):
    assert one(spark, "http://arxiv.org/abs/12.3", T.pdf_url) == "https://arxiv.org/pdf/12.3.pdf"
    assert one(spark, "a.PDF", T.is_pdf) is False
    assert one(spark, "é b/c", T.sanitized) == "é_b_c"
    assert one(spark, "/x/free.fall.txt", T.stem) == "free.fall"
    assert one(spark, "http://a//", T.no_trailing_slash) == "http://a"


def test_page_text():
    html = "<nav>x<b>y</b></nav><p>one <b>two</b></p><script>var t='<p>no</p>'</script>\n\n<p>three</p>"
    assert T.page_text(html) == "one\ntwo\nthree"
    assert T.page_text(None) == ""


def test_lenient_json(spark):
    assert one(spark, ' {"a":1} ', J.lenient_json) == '{"a":1}'
    assert one(spark, 'x ```json\nbad\n``` ```\n{"a":2}\n```', J.lenient_json) == '{"a":2}'
    assert one(spark, 'so {"a":3} ok', J.lenient_json) == '{"a":3}'
    assert one(spark, "list [1,2] ok", J.lenient_json) == "[1,2]"
    assert one(spark, None, J.lenient_json) == "{}"
    assert "raw_output" in one(spark, "none", J.braces_json)


def test_decisions(spark):
    assert one(spark, " Complete ", J.decision) == "complete"
    assert one(spark, "done", J.decision) == "to_revise"
    assert one(spark, "1.7", J.reward) == 1.7
    assert one(spark, "high", J.reward) == 0.0
    assert one(spark, "abc", lambda c: J.md5_route(c, 7)) == 0
    assert one(spark, '{"a":["x",null,"y"],"b":""}', J.natural_text) == "a: x y"


def test_registry(spark):
    registry.register(spark)
    assert spark.sql("SELECT tool_name('a-b') AS n, word_overlap(array('x'), array('x', 'y')) AS o").first() == ("a_b", 1)
    assert registry.listing(spark).count() == 6
