"""The node table rendered in Catalyst against the renderer of trees, and against Markdown written by hand."""

import random
from collections import defaultdict

from pyspark.sql import types as T

from folium import cases
from folium.model import NODE, Document, MarkdownOptions, node, node_rows, paragraph, text
from folium.operators import fold as folding
from folium.render import render

SCHEMA = T.StructType([T.StructField("doc", T.StringType()), *NODE.fields])


def folded(spark, docs, options=None):
    rows = [(name, *r) for name, doc in docs.items() for r in node_rows(doc.blocks)]
    meta = [(name, [{"key": k, "value": v} for k, v in doc.metadata.items()]) for name, doc in docs.items()]
    meta = spark.createDataFrame(meta, "doc string, metadata array<struct<key:string,value:string>>")
    return dict(folding.fold(spark.createDataFrame(rows, SCHEMA).repartition(3), "doc", options, meta).collect())


def test_hand_made_cases(spark):
    by_options = defaultdict(dict)
    for part, (make, _, options) in cases.RENDERED.items():
        by_options[options][part] = make("word")
    for options, docs in by_options.items():
        got = folded(spark, docs, options)
        for part in docs:
            assert got.get(part, "") == cases.RENDERED[part][1].replace("{n}", "word"), part


def tree(r):
    """A document of every kind of node, with texts that mean something in Markdown."""
    word = lambda: "".join(r.choice(["a", "b", " ", "*", "_", "`", "\n", "#", "1.", "- ", "|", "[", "é", "😀", "<i", "&amp;", "\t", ">", "\r\n"]) for _ in range(r.randrange(9)))

    def inlines(deep):
        out = []
        for _ in range(r.randrange(4)):
            kind = r.choice(["text"] * 4 + ["line_break", "code_span", "image", "raw_inline"] + ["strong", "emphasis", "strikethrough", "link"] * (deep > 0))
            x = node(kind, text=word()) if kind != "line_break" else node(kind)
            if kind in ("strong", "emphasis", "strikethrough", "link"):
                x = node(kind, content=inlines(deep - 1))
            if kind in ("link", "image"):
                x |= {"url": r.choice(["", "u v", "http://x/(y)"]), "link_title": r.choice([None, 'a "b"'])}
            out.append(x)
        return out

    def blocks(deep):
        out = []
        for _ in range(r.randrange(4)):
            kind = r.choice(["paragraph"] * 3 + ["heading", "code_block", "thematic_break", "html_comment", "raw_block", "table"] + ["block_quote", "list", "list"] * (deep > 0))
            if kind == "block_quote":
                out.append(node(kind, blocks=blocks(deep - 1)))
            elif kind == "list":
                items = [node("list_item", blocks=blocks(deep - 1), checked=r.choice([None, None, True, False])) for _ in range(r.randrange(12))]
                out.append(node(kind, items=items, ordered=r.random() < 0.5, start=r.choice([None, 1, 7]), loose=r.random() < 0.3))
            elif kind == "table":
                cell = lambda: node("table_cell", col_span=r.choice([None, 1, 3]), **({"content": inlines(1)} if r.random() < 0.5 else {"text": word()}))
                row = lambda: [cell() for _ in range(r.randrange(4))]
                out.append(node(kind, header=row(), rows=[node("table_row", cells=row()) for _ in range(r.randrange(3))], alignments=["RIGHT", "CENTER"][: r.randrange(3)], caption=inlines(1)))
            elif kind in ("paragraph", "heading"):
                out.append(node(kind, content=inlines(2), level=r.randrange(9)) if kind == "heading" else paragraph(inlines(2)))
            else:
                out.append(node(kind, text=word(), language=r.choice([None, "py"])))
        return out

    return Document(blocks(3))


def test_random_trees(spark):
    r = random.Random(7)
    docs = {f"d{i}": tree(r) for i in range(200)}
    for options in (None, MarkdownOptions(escape_text=False, pad_table_columns=True, bullet="+", images_as_text=True)):
        got = folded(spark, docs, options)
        for k, doc in docs.items():
            assert got.get(k, "") == render(doc, options), k


def test_levels_and_odd_tables(spark, monkeypatch):
    quote = paragraph([text("deep")])
    for _ in range(14):  # more levels than a plan holds
        quote = node("block_quote", blocks=[quote])
    docs = {"deep": Document([quote]), "wide": Document([paragraph([text(f"p{i}")]) for i in range(3000)])}
    got = folded(spark, docs)
    assert got == {"deep": "> " * 14 + "deep", "wide": "\n\n".join(f"p{i}" for i in range(3000))}
    assert folding.fold(spark.createDataFrame([], SCHEMA), "doc").count() == 0
    null_key = spark.createDataFrame([("x", *r) for r in node_rows([paragraph([text("a")])])], SCHEMA).withColumnRenamed("doc", "node")
    assert folding.fold(null_key, "node").collect()[0]["markdown"] == "a"


def test_no_python_in_the_plan(spark):
    rows = spark.createDataFrame([("x", *r) for r in node_rows([paragraph([text("a")])])], SCHEMA)
    plan = folding.fold(rows, "doc")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Parquet" in plan
