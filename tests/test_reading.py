"""Pages, folders, terms, code words and token F1 on small cases."""

import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from recollect.functions import text as T
from recollect.functions.pages import page_text
from recollect.plans.retrieval import tokens_lex
from recollect.sources.ingest import read_folder, source_type


def stripped(html):
    """A character at a time."""
    if "<html" not in html and "<HTML" not in html:
        return html
    out, tag, script, style = [], False, False, False
    for i, c in enumerate(html):
        if c == "<":
            head = html[i : i + 20].lower()
            script = (script or head.startswith("<script")) and not head.startswith("</script")
            style = (style or head.startswith("<style")) and not head.startswith("</style")
            tag = True
        elif c == ">":
            tag = False
        elif not (tag or script or style):
            out.append(" " if c in "\n\r\t" else c)
    text = "".join(out)
    while "  " in text:
        text = text.replace("  ", " ")
    return text


def test_pages_without_their_tags(spark):
    pages = [
        "<html><head><style>p{margin:0}</style><SCRIPT>var t='</p>'; if (a<b) x();</SCRIPT></head><body><p>One\n\n two</p><br/>&amp; three > four</body></html>",
        "<html>a<script>never closed <b>x", "<html>b <i unclosed", "no page <b>at</b> all", "", "<HTML>é\t\t<style>x</style >y",
    ]
    found = spark.createDataFrame([(i, p) for i, p in enumerate(pages)] + [(9, None)], "i int, h string").select("i", page_text(F.col("h")).alias("t")).orderBy("i").collect()
    assert [r.t for r in found] == [*map(stripped, pages), None]


def test_folders_of_text(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    for name, body in [("a/x.md", "one\ntwo\n"), ("a/b/y.py", "z = 1"), ("a/b/z.bin", "no"), ("a/empty.txt", "")]:
        (tmp_path / name).write_text(body)
    found = {r.path.rsplit("/", 1)[-1]: r.content for r in read_folder(spark, f"file://{tmp_path}").collect()}
    assert set(found) == {"x.md", "y.py"} and found["x.md"].startswith("# Source: ") and found["x.md"].endswith("x.md\n\none\ntwo\n")
    assert [source_type(x) for x in ("https://e.org", "http://e.org/a", "/data/", "/data/x.md")] == ["url", "url", "directory", "file"]


@pytest.mark.parametrize(
    ("text", "terms", "code"),
    [
        ("How does the FileReader's cache-line work?", ["filereaders", "cacheline", "work"], ["reader", "cach", "line", "work"]),
        ("parseHTTPRequest2 loadedItems", ["parsehttprequest2", "loadeditems"], ["pars", "httprequest", "load", "item"]),
        ("a1b2 x caching sing bed used bus", ["a1b2", "caching", "sing", "bed", "used", "bus"], ["cach", "sing", "bed", "used", "bus"]),
        ("", [], []),
        ("É été", [], []),
    ],
)
def test_terms_and_code_words(spark, text, terms, code):
    r = spark.createDataFrame([(text,)], "t string").select(T.extract_terms(F.col("t")).alias("a"), T.code_words(F.col("t")).alias("b")).first()
    assert (r.a, r.b) == (terms, code)


def test_token_f1(spark):
    rows = [("a b b c", "b b d", 2 * 2 / 7), ("x", "y", 0.0), ("", "", 0.0), ("A-a", "a A", 1.0)]
    found = spark.createDataFrame([(a, b) for a, b, _ in rows], "a string, b string").select(T.token_f1("a", "b")).collect()
    assert [round(r[0], 9) for r in found] == [round(f, 9) for _, _, f in rows]


def test_token_f1_of_long_texts(spark):
    rows = [(" ".join(f"w{i % m}" for i in range(40_000)), " ".join(f"w{i % 7_000}" for i in range(40_000))) for m in (9_000, 14_000)] + [(None, "a")]
    began = time.time()
    found = [r[0] for r in spark.createDataFrame(rows, "a string, b string").select(T.token_f1("a", "b")).collect()]
    assert time.time() - began < 60  # comparing each distinct word with all others takes hours
    shared = lambda a, b: 2 * sum((Counter(a.split()) & Counter(b.split())).values()) / 80_000
    assert [round(f, 9) for f in found] == [round(shared(a, b), 9) for a, b in rows[:2]] + [0.0]


def test_tokens_are_found_once_a_text(spark, tmp_path):
    spark.createDataFrame([(1, "The Retry-loop of a retry_loop"), (2, "a b"), (3, None)], "doc_id long, text string").selectExpr("*", "'en' lang", "'s' source").write.parquet(f"{tmp_path}/documents.parquet")
    found = tokens_lex(spark, str(tmp_path))
    assert [(r.memory_id, r.n_tokens) for r in found.collect()] == [(1, 4)]
    # Two patterns, each once: a filter doesn't run them again.
    assert found._jdf.queryExecution().executedPlan().toString().split("FileScan")[0].count("regexp_extract_all") == 2
