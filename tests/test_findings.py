"""Small cases of faults that a review found."""

from pyspark.sql import functions as F
from pyspark.sql import types as T
import duckdb
import pyarrow as pa
import random
import re

from folium import queries
from folium.functions import columns as C
from folium.functions.reflow import BROKEN, SEARCHED, reflowed, repaired
from folium.functions.urls import resolved
from folium.operators import convert as ops
from folium.model import NODE, Document, node, node_rows, paragraph, text
from folium.operators import corpus, elements
from folium.operators import fold as folding
from folium.parsers import html_tree
from folium.parsers.html_tree import tokens
from folium.parsers.plain import repair_hyphens, text_blocks
from folium.render import render


def test_output_without_tokens_has_none_of_the_consensus(spark):
    rows = [("f", "a", "some words here"), ("f", "b", "some words"), ("f", "c", "- x"), ("g", "a", "x"), ("g", "c", "lonely")]
    measured = corpus.measures(spark.createDataFrame(rows, "file string, engine string, markdown string"))
    got = {(r["file"], r["engine"]): r["recall"] for r in measured.collect()}
    assert got == {("f", "a"): 1.0, ("f", "b"): 1.0, ("f", "c"): 0.0, ("g", "a"): 1.0, ("g", "c"): 1.0}
    totals = {r["engine"]: r["mean_recall"] for r in corpus.totals(measured).collect()}
    assert totals == {"a": 1.0, "b": 1.0, "c": 0.5}


def test_titles_with_references_without_semicolon(spark):
    pages = spark.createDataFrame([("<title>a&amp;b&amp</title>",), ("<title>&lt;c &#38; d&#38</title>",), ("<title>e & f</title>",)], "html string")
    titles = lambda **more: [r["title"] for r in ops.titles(pages, **more).collect()]
    assert titles() == ["a&b&", "<c & d&", "e & f"]
    assert titles(terminated=True) == ["a&b&amp", "<c & d&#38", "e & f"]


def cut_pages(spark, path):
    """A page of sf0.001 with title and heading cut at each place of some references, as pages of larger tables have them."""
    page = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").where("page_id = 0").first()
    texts = [f"a b {x[:k]}" for x in ("&quot;", "&amp;", "&lt;", "&gt;", "&copy;") for k in range(1, len(x) + 1)] + ["a &ampquot; b", "a &amp;lt b", "a &quotb c"]
    put = lambda x: re.sub("<h1>[^<]*", f"<h1>{x}", re.sub("<title>[^<]*", f"<title>{x}", page["html"]))
    rows = [(i, page["url"], put(x)) for i, x in enumerate(texts)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    return str(path)


def as_sql(spark, d, name):
    """The rows of a query over pages, and those of its SQL."""
    df = queries.QUERIES[name](spark, d)
    sql = f"with pages as (select * from '{d}/pages.parquet/*.parquet') select {','.join(df.columns)} from ({queries.ORACLES[name]}) order by page_id"
    return [tuple(r) for r in df.orderBy("page_id").collect()], duckdb.connect().execute(sql).fetchall()


def test_pages_with_references_cut_off(spark, tmp_path):
    got, expected = as_sql(spark, cut_pages(spark, tmp_path), "html_to_markdown")
    assert len(got) == 28 and got == expected


def test_nodes_of_pages_with_references_cut_off(spark, tmp_path):
    got, expected = as_sql(spark, cut_pages(spark, tmp_path), "render_nodes")
    assert len(got) == 28 and got == expected


def test_batches_are_parsed_in_slices():
    seen = []

    def run(numbers, texts):
        seen.append(len(texts))
        return pa.array([None if x is None else f"{n}{x[:1]}" for n, x in zip(numbers.to_pylist(), texts.to_pylist())], pa.string())

    texts = pa.array(["a" * 1000] * 500 + [None] * 10 + ["b" * 1000] * 490)
    numbers = pa.array(range(1000))
    got = ops.sliced(run, by=1, max_bytes=50_000)(numbers, texts)
    assert got.equals(run(numbers, texts)) and max(seen[:-1]) <= 60 and len(seen) > 15
    assert len(ops.sliced(run, by=1)(numbers[:0], texts[:0])) == 0


def test_documents_stay_where_they_are_read_beside_the_first_of_their_language(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = queries.QUERIES["token_similarity"](spark, "/root/testdata/sf0.001")
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


def test_a_reference_is_taken_apart_once(spark):
    df = spark.createDataFrame([("http://a/b", "c")], "b string, r string").select(resolved(F.col("b"), F.col("r")).alias("u"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract") <= 2 and len(plan) < 12_000


def test_words_are_lowered_with_the_whole_text(spark):
    texts = ["B aß Äb AB ab x", "ΑΣ'ΒΓ ΑΣ", "İstanbul b", ""]
    df = spark.createDataFrame([(x,) for x in texts], "text string")
    got = [r["v"] for r in df.select(C.vocabulary(F.col("text")).alias("v")).collect()]
    assert got == [["ab", "ab", "aß", "äb"], ["ας", "ας", "βγ"], ["i̇stanbul"], []]
    plan = df.select(C.vocabulary(F.col("text")))._jdf.queryExecution().optimizedPlan().toString()
    assert "array_distinct" not in plan


def test_words_of_short_and_long_texts_are_found_alike(spark):
    r = random.Random(3)
    pieces = ["ab", "Abc", "é", "xy", "-\n", "-\n", BROKEN, " ", " ", "\n", "ΑΣ", "ας", "İ", "1", "ab-\ncd "]
    texts = ["".join(r.choice(pieces) for _ in range(r.randrange(60))) for _ in range(300)]
    texts += [x + " padding" * SEARCHED for x in texts[:20]] + ["", BROKEN, "a b-\nb"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    rows = df.select("i", reflowed(F.col("text")).alias("p"), repaired(F.col("text")).alias("r")).collect()
    assert {x["i"]: x["r"] for x in rows} == {i: repair_hyphens(x) for i, x in enumerate(texts)}
    assert {x["i"]: x["p"] for x in rows} == {i: text_blocks(x) for i, x in enumerate(texts)}
    plan = df.select(reflowed(F.col("text")))._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(" in plan or "contains(" in plan.lower()


def test_elements_are_marked_once_and_keep_their_rows(spark):
    df = queries.QUERIES["html_tables"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.count("Window [") == 2
    pages = [(1, "<table><tr><td>a<table><tr></tr></table></table>" + "<form><table><tr><td>x</table></form>"), (2, None), (3, "<p>no table</p>"), (4, "<form><table><tr><td>x</table></form>")]
    table = elements.element_table(spark.createDataFrame(pages, "page long, html string"), "page")
    got = {r["page"]: tuple(r)[1:] for r in elements.document_tables(table, "page").collect()}
    assert got == {1: (1, 1, 0, 5)}


def test_tags_of_a_name_alone_are_read_like_others():
    spaced = lambda x: re.sub(r"<(/?\w+)>", r"<\1 >", x) if "<script" not in x and "<title" not in x else x
    r = random.Random(6)
    pieces = ["<table>", "<tr>", "<TD>", "</td>", "</table>", "<p>", "<b>", "</b>", "<script>", "</script>", "<pre>", "\n", "a", "<averylongelementname>", "<title>", "</title>", "<form>", "\r\n", "&lt;"]
    for _ in range(300):
        source = "".join(r.choice(pieces) for _ in range(r.randrange(40)))
        assert list(tokens(source)) == [("start", t[1], t[2], False) if t[0] == "start" else t for t in tokens(spaced(source))]
    known = len(html_tree._plain)
    list(tokens("".join(f"<x{i}>" for i in range(5000))))
    assert known <= len(html_tree._plain) <= html_tree._REMEMBERED


def test_nodes_are_exchanged_once_by_document(spark):
    rows = [("a", *r) for r in node_rows([node("block_quote", blocks=[paragraph([text("x"), node("strong", content=[text("y")])])]), paragraph([text("z")])])]
    nodes = spark.createDataFrame(rows, T.StructType([T.StructField("doc", T.StringType()), *NODE.fields]))
    df = folding.fold(nodes, "doc")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = folding.fold(nodes, "doc")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert plan.count("Exchange hashpartitioning(key") == plan.count("Exchange") == max(r[3] for r in rows) + 1 and "Join" not in plan
    assert [tuple(r) for r in df.collect()] == [("a", "> x**y**\n\nz")]
    made = queries.QUERIES["fold_orders"](spark, "/root/testdata/sf0.001")
    assert made._jdf.queryExecution().optimizedPlan().toString().count("Relation") <= 7


def test_tokens_are_not_exchanged_and_repeated_outputs_count_once(spark):
    rows = [("f", "a", "some words here"), ("f", "a", "words again"), ("f", "b", "some other words"), ("f", "c", "-"), ("g", "a", "lonely"), ("f", None, "again")]
    measured = corpus.measures(spark.createDataFrame(rows, "file string, engine string, markdown string"))
    got = sorted((r["file"], r["engine"] or "", round(r["recall"], 6), r["unique_tokens"]) for r in measured.collect())
    # some, words and again are given by two; here by a alone, other by b alone
    assert got == [("f", "", 0.0, 0), ("f", "a", 1.0, 1), ("f", "a", 1.0, 1), ("f", "b", 0.666667, 1), ("f", "c", 0.0, 0), ("g", "a", 1.0, 1)]
    assert "Exchange hashpartitioning(file" in (plan := measured._jdf.queryExecution().executedPlan().toString())
    assert not any("Exchange" in x and "token#" in x for x in plan.split("\n"))


def test_leaves_are_made_before_the_levels_and_fields_may_be_left_out(spark):
    blocks = [
        node("thematic_break"), node("block_quote", blocks=[node("code_block", text="a_b\n"), paragraph([text("x_ |"), node("strong", content=[text("# y"), node("line_break")]), text("1. z")])]),
        node("list", items=[node("list_item", blocks=[paragraph([text("- i")]), node("html_comment", text="c")]), node("list_item", blocks=[])]), node("raw_block", text="r\n\n\n\ns")
    ]
    nodes = spark.createDataFrame([("a", *r) for r in node_rows(blocks)], T.StructType([T.StructField("doc", T.StringType()), *NODE.fields]))
    df = folding.fold(nodes.drop("loose", "checked", "col_span", "row_span", "alignments", "url", "link_title", "asset_id", "anchor"), "doc")
    # a comment is a leaf: no level makes any
    assert "<!-- " not in df._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in df.collect()] == [("a", render(Document(blocks)))]
