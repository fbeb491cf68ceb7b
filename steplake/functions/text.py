"""Text functions as column expressions."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Words without meaning for matching (fixed values).
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from",
    "in", "is", "it", "of", "on", "or", "that", "the", "this", "to",
    "with", "without", "via", "use", "using", "based",
    "problem", "task", "workflow", "methodology", "method",
)
#: What stands between the halves of a shortened text (fixed value).
CUT_MARK = "\n... [truncated] ...\n"
#: Elements that page text leaves out (fixed values).
DROPPED = ("script", "style", "noscript", "header", "footer", "nav")
#: Characters of a chunk where no tokenizer is at hand, and tokens by model family (fixed values).
CHUNK_CHARS = 20000
CHUNK_TOKENS = {"qwen": 6000, "deepseek": 12000}
CHUNK_DEFAULT = 8000


def strip(c: Column) -> Column:
    """Without white space at either end (tabs and line ends too)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def tokens(c: Column) -> Column:
    """Runs of a-z, 0-9 and _, and of CJK characters, in lower case; null gives none."""
    return F.regexp_extract_all(F.lower(F.coalesce(strip(c), F.lit(""))), F.lit(r"([a-z0-9_]+|[一-鿿]+)"), F.lit(1))


def content_tokens(c: Column) -> Column:
    """Tokens that aren't stop words, in order, repeats kept."""
    return F.filter(tokens(c), lambda t: ~t.isin(*STOP_WORDS))


def safe_short(c: Column, limit: int) -> Column:
    """Texts over the limit as their first and last half of it, with a mark between."""
    text, half = F.coalesce(c.cast("string"), F.lit("")), max(1, limit // 2)
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(half)), F.lit(CUT_MARK), F.right(text, F.lit(half)))).otherwise(text)


def strip_front_matter(c: Column) -> Column:
    """Text after a leading block between two lines of dashes."""
    parts = F.split(c, "---", 3)
    return F.when(F.startswith(c, F.lit("---")) & (F.size(parts) == 3), F.regexp_replace(F.element_at(parts, 3), r"^\s+", "")).otherwise(c)


def front_matter(c: Column) -> Column:
    """Flat ``key: value`` pairs of a leading block, as a map; no block gives an empty one."""
    parts = F.split(c, "---", 3)
    rows = F.filter(F.split(F.element_at(parts, 2), "\n"), lambda x: F.contains(x, F.lit(":")))
    pairs = F.transform(rows, lambda x: F.struct(strip(F.element_at(F.split(x, ":", 2), 1)).alias("k"), F.regexp_replace(strip(F.element_at(F.split(x, ":", 2), 2)), "^[\"']|[\"']$", "").alias("v")))
    none = F.array().cast("array<struct<k:string,v:string>>")
    return F.map_from_entries(F.when(F.startswith(c, F.lit("---")) & (F.size(parts) == 3), pairs).otherwise(none))


def first_paragraph(c: Column, limit: int = 280) -> Column:
    """The first paragraph that isn't a heading, on one line, cut at the limit."""
    paragraphs = F.transform(F.split(strip_front_matter(c), r"\n\s*\n"), lambda p: strip(F.regexp_replace(p, r"\s+", " ")))
    first = F.coalesce(F.get(F.filter(paragraphs, lambda p: (p != "") & ~F.startswith(p, F.lit("#"))), F.lit(0)), F.lit(""))
    return F.concat(F.left(first, F.lit(limit)), F.when(F.length(first) > limit, "...").otherwise(""))


def one_line(c: Column, limit: int = 240) -> Column:
    """White space as single blanks; over the limit, three less and dots."""
    line = strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    return F.when(F.length(line) > limit, F.concat(F.left(line, F.lit(limit - 3)), F.lit("..."))).otherwise(line)


def bullets(items: Column, most: int = 6) -> Column:
    """The first items as bullet lines."""
    return F.array_join(F.transform(F.slice(items, 1, most), lambda x: F.concat(F.lit("- "), x)), "\n")


def sanitized(c: Column) -> Column:
    """Letters and digits of any script, dot, underscore and dash; others become _."""
    return F.regexp_replace(c, r"[^\p{L}\p{N}._-]", "_")


def chunks(c: Column, size: int = CHUNK_CHARS) -> Column:
    """Pieces of ``size`` characters; an empty text has none."""
    n = F.ceil(F.length(c) / F.lit(size)).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substr(c, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def chunk_tokens(model: Column) -> Column:
    """Tokens of a chunk by the family named in a model's name."""
    out = F.when(F.lit(False), 0)
    for family, n in CHUNK_TOKENS.items():
        out = out.when(F.contains(F.lower(model), F.lit(family)), n)
    return out.otherwise(CHUNK_DEFAULT)


#: Tokens of a chunk of a paper (fixed value).
PAPER_TOKENS = 120000


def token_chunks(vocabulary: str, size: int):  # noqa: ANN201
    """A function that cuts texts into pieces of ``size`` tokens of a vocabulary file.

    The file's path must be the same on every executor. Where the tokenizer can't
    be had or fails, pieces have CHUNK_CHARS characters.
    """

    @F.pandas_udf("array<string>")
    def cut(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        try:
            from tokenizers import Tokenizer

            known = Tokenizer.from_file(vocabulary)
        except Exception:  # any failure of the library means pieces of characters
            known = None

        def one(t: str | None) -> list[str]:
            if not t:
                return []
            if known is None:
                return [t[i : i + CHUNK_CHARS] for i in range(0, len(t), CHUNK_CHARS)]
            ends = [e for _, e in known.encode(t, add_special_tokens=False).offsets]
            marks = [0, *(ends[i - 1] for i in range(size, len(ends), size)), len(t)]
            return [t[a:b] for a, b in zip(marks, marks[1:], strict=False)]

        for s in texts:
            yield s.map(one)

    return cut


def fill(template: str, **values: Column) -> Column:
    """A template's {names} replaced by columns."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def doubled_parens(c: Column) -> Column:
    """Backslash before ( or ) doubled, so that JSON can be parsed."""
    return F.replace(F.replace(c, F.lit("\\("), F.lit("\\\\(")), F.lit("\\)"), F.lit("\\\\)"))


def after_think(c: Column) -> Column:
    """Text after the last closing think tag."""
    return strip(F.substring_index(c, "</think>", -1))


def pdf_url(c: Column) -> Column:
    """arXiv abstract addresses as those of their PDF."""
    return F.when(F.contains(c, F.lit("arxiv.org/abs/")), F.concat(F.lit("https://arxiv.org/pdf/"), F.substring_index(c, "/", -1), F.lit(".pdf"))).otherwise(c)


def is_pdf(link: Column, content_type: Column | None = None) -> Column:
    """Whether a link is read as PDF."""
    kind = F.lit("") if content_type is None else F.coalesce(content_type, F.lit(""))
    return F.contains(link, F.lit(".pdf")) | F.contains(link, F.lit("arxiv.org/abs/")) | F.contains(link, F.lit("arxiv.org/pdf/")) | F.contains(kind, F.lit("pdf"))


def no_trailing_slash(c: Column) -> Column:
    return F.regexp_replace(c, "/+$", "")


def stem(c: Column) -> Column:
    """File name without directory and last suffix."""
    return F.regexp_replace(F.substring_index(c, "/", -1), r"(?<=.)\.[^.]*$", "")


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.inside: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in DROPPED:
            self.inside.append(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in self.inside:
            while self.inside.pop() != tag:
                pass

    def handle_data(self, data: str) -> None:
        if not self.inside:
            self.out += [x.strip() for x in data.splitlines() if x.strip()]


def page_text(html: str | None) -> str:
    """Visible text of a page, a line for each piece; an unclosed dropped element hides the rest."""
    p = _Text()
    p.feed(html or "")
    p.close()
    return "\n".join(p.out)


@F.pandas_udf(StringType())
def html_to_text(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """``page_text`` by Arrow batches: no built-in function parses HTML."""
    for s in pages:
        yield s.map(page_text)
