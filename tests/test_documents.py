import io
import struct
import time
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folium import cases
from folium.functions import columns as C
from folium.functions.png import encode_png
from folium.model import NODE, Document, DocumentBuilder, MarkdownOptions, from_nodes, node, paragraph, plain_cell, styled, table, text, to_nodes
from folium.operators import convert as ops
from folium.operators import corpus
from folium.parsers import plain
from folium.parsers.html_walk import html_document
from folium.plans.registry import Converter, Registry
from folium.render import escape, render
from folium.sources.archive import ZipArchive, parse_epub


def put(case, word):
    return case.replace("{n}", word)


@pytest.mark.parametrize("part", cases.RENDERED)
def test_rendered_cases(part):
    made, expected, options = cases.RENDERED[part]
    assert render(made("word"), options) == put(expected, "word")
    # the same from node lists
    doc = made("word")
    assert render(Document(from_nodes(to_nodes(doc.blocks)), metadata=doc.metadata), options) == put(expected, "word")


@pytest.mark.parametrize("part", cases.HTML)
def test_html_cases(part):
    source, expected = cases.HTML[part]
    assert md(put(source, "word")) == put(expected, "word")


@pytest.mark.parametrize("part", cases.OTHERS)
def test_format_cases(part):
    kind, source, expected = cases.OTHERS[part]
    parse = next(c.parse for c in Registry().converters if kind in c.extensions)
    assert render(parse(put(source, "word").encode(), "")) == put(expected, "word")


@pytest.mark.parametrize(("given", "run"), [(cases.REFLOWED, lambda s: "\n\n".join(plain.text_blocks(s))), (cases.REPAIRED, plain.repair_hyphens)])
def test_text_cases(given, run):
    assert {k: run(put(source, "word")) for k, (source, _) in given.items()} == {k: put(expected, "word") for k, (_, expected) in given.items()}


def test_trees_of_any_depth():
    for tag in ("div", "span", "b", "blockquote", "ul><li", "table><td"):
        assert "x" in md(f"<{tag}>" * 2000 + "x")
    deep = html_document("<blockquote>" * 3000 + "x")
    assert render(Document(from_nodes(to_nodes(deep.blocks)))) == render(deep) == "> " * 3000 + "x"
    began = time.process_time()
    md("<div>" * 30_000 + "x")
    plain.repair_hyphens("\u6f22" * 300_000 + "\ufffex")
    assert time.process_time() - began < 20


def test_title_is_the_head_s():
    assert html_document("<svg><title>icon</title></svg><h1>Real").title == "Real"
    assert html_document("<title>\u00a0a\u200b \n b</title><h1>c").title == "a b" and html_document("<p>a<title>t</title>").title is None
    assert html_document("<h1> </h1><h2><b> b </b></h2>").title == "b" and html_document("<p>a").title is None


def test_builder_keeps_what_it_is_given():
    b = DocumentBuilder().asset({"id": "a", "media_type": "m"}).asset({"id": "a", "media_type": "m"}).comment("").code(" ").bullet_list([" "])
    assert len(b.document.assets) == 2 and [x["kind"] for x in b.document.blocks] == ["html_comment", "code_block", "list"]
    assert b.title_if_absent(None).title_if_absent("\n").document.title is None and b.title("").title_if_absent("x").document.title == ""
    assert styled([], bold=True) == [node("strong", content=[])]


def md(source, base=""):
    return render(html_document(source, base))


@pytest.mark.parametrize(
    ("source", "expected"),
    [
        ("<table><tr><td>1</td></tr></table>", "|  |\n| --- |\n| 1 |"),
        ("<table><tr><th colspan=2>A</th></tr><tr><td>1</td><td>2</td></tr></table>", "| A |  |\n| --- | --- |\n| 1 | 2 |"),
        ("<ol start=3><li>a<li><li>c</ol>", "3. a\n4. c"),
        ("<ul><li>a<ul><li>b</ul></ul>", "- a\n\n  - b"),
        ("<p><br></p>", "\\"),
        ('<a href="javascript:x">t</a>', "t"),
        ("<form><p>x</p></form>", ""),
        ('<pre><code class="language-py">a```b\n</code></pre>', "````py\na```b\n````"),
        ("<dl><dt>k<dd>v</dl>", "**k**\n\nv"),
        ("<p><b>A<br><p>B</p><p><b>C<br><p>D</p>", "**A\\**\n\n**B**\n\n****C\\****\n\n****D****"),
        ("<b>1<p>2</b>3</p>", "**1**\n\n**2**3"),
        ("<table>x<tr><td>a</table>", "x\n\n|  |\n| --- |\n| a |"),
        ("<p>a &amp; b<!-- no --><script>var x='</p>'</script></p>", "a & b"),
        ("", ""),
    ],
)
def test_html(source, expected):
    assert md(source) == expected


def test_html_links_and_title():
    doc = html_document("<title> T\n t </title><h1>H</h1><a href='/x y'>l</a>", "http://e.org/a/")
    assert doc.title == "T t" and "[l](http://e.org/x%20y)" in render(doc)
    assert html_document("<h1> H <i>i</i></h1>").title == "H i"


def test_csv():
    assert plain.csv_records('a,b\n\n1,2\r\n" x ",y""\n') == [["a", "b"], ["1", "2"], [" x ", 'y"']]
    assert plain.csv_records("a,b\n1\n2,3,4") == [["a", "b"], ["1"], ["2", "3", "4"]]
    assert plain.parse_csv(b"").blocks == []
    assert render(plain.parse_csv("﻿h\nx|y\n".encode())) == "| ﻿h |\n| --- |\n| x\\|y |"


def test_json_and_xml():
    assert plain.pretty_json('{"a":1.50,"b":[],"c":{"d":null}}') == '{\n    "a": 1.50,\n    "b": [],\n    "c": {\n        "d": null\n    }\n}'
    for broken in ('{"a":"x', "[1,", "{"):
        assert plain.pretty_json(broken) == broken
    assert plain.pretty_json('{"a":1') == '{\n    "a": 1'
    assert [plain.pretty_xml(x) for x in ("<a/>", "<a></a>", "<a>t</a>", "none")] == ["<a/>", "<a>\n</a>", "<a>t</a>", "none"]


def test_reflow_and_repair():
    assert plain.text_blocks("conver-\nsation") == ["conver-sation"] and plain.text_blocks("a-\nb") == ["ab"]
    assert plain.text_blocks("a\n b\n \nc", reflow=False) == ["a\nb", "c"]
    assert plain.repair_hyphens("con￾firming") == "confirming"
    assert plain.repair_hyphens("chat￾optimized chat optimized") == "chat-optimized chat optimized"


@pytest.mark.parametrize(
    ("source", "expected"),
    [("1. a", "1\\. a"), ("# b", "\\# b"), ("- c", "\\- c"), ("a_b", "a_b"), ("_a_", "\\_a\\_"), ("x<y", "x\\<y"), ("x< y", "x< y"), ("&amp;", "\\&amp;"), ("A & B", "A & B"), ("a|b", "a|b"), ("[x]*`\\", "\\[x\\]\\*\\`\\\\")],
)
def test_escape_python_and_native_agree(spark, source, expected):
    assert escape(source) == expected
    row = spark.createDataFrame([(source,)], "s string").select(C.escape(F.col("s")), C.escape(F.col("s"), table=True, line_start=False)).first()
    assert (row[0], row[1]) == (expected, escape(source, line_start=False, table=True))


def test_renderer_only_parts():
    items = [node("list_item", blocks=[paragraph([text("a")])], checked=True), node("list_item", blocks=[paragraph([text("b")])], checked=False)]
    doc = Document([node("list", ordered=False, loose=True, items=items), table([plain_cell("h")], [[plain_cell("v")]], ["CENTER"], [text("cap")]), node("html_comment", text=" c "), node("thematic_break")], metadata={"k": "v\nw"})
    assert render(doc) == "- [x] a\n\n- [ ] b\n\n| h |\n| :-: |\n| v |\n\n*cap*\n\n<!-- c -->\n\n---"
    assert render(doc, MarkdownOptions(front_matter=True)).startswith("---\nk: v w\n---\n\n- [x]")
    assert render(Document([node("heading", level=9, content=[text("x")])]), MarkdownOptions(max_heading_level=3)) == "### x"
    image = Document([paragraph([node("image", text="a]b", url="http://long", link_title='q"')])])
    assert render(image) == '![a\\]b](http://long "q\\"")' and render(image, MarkdownOptions(max_inline_image_url=3)) == "a\\]b"
    assert render(Document([table([plain_cell("ab")], [[plain_cell("c")]])]), MarkdownOptions(pad_table_columns=True)) == "| ab  |\n| --- |\n| c   |"
    assert render(Document([paragraph(styled([text("x")], bold=True, italic=True, strike=True))])) == "***~~x~~***"


def test_builder_and_nodes_round_trip():
    b = DocumentBuilder().heading(1, "T").paragraph(" ").bullet_list(["a", ""]).table(["x"], [["1"]]).meta("k", " ").meta("l", "v").code("c", "py").raw("r").title_if_absent("t").title_if_absent("u")
    doc = b.build()
    assert doc.title == "t" and doc.metadata == {"l": "v"} and [x["kind"] for x in doc.blocks] == ["heading", "list", "table", "code_block", "raw_block"]
    assert render(Document(from_nodes(to_nodes(doc.blocks)))) == render(doc)


def _book():
    made = io.BytesIO()
    with zipfile.ZipFile(made, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="O/b.opf"/></rootfiles></container>')
        z.writestr("O/b.opf", '<package><metadata><dc:title>T</dc:title><dc:creator>A</dc:creator></metadata><manifest><item id="b" href="2.xhtml" media-type="application/xhtml+xml"/><item id="a" href="1.xhtml" media-type="application/xhtml+xml"/><item id="c" href="s.css" media-type="text/css"/></manifest><spine><itemref idref="a"/><itemref idref="b"/></spine></package>')
        z.writestr("O/1.xhtml", "<html><body><p>one</p></body></html>", zipfile.ZIP_STORED)
        z.writestr("O/2.xhtml", "<html><body><p>two</p></body></html>")
    return made.getvalue()


def test_epub_and_zip():
    assert render(parse_epub(_book())) == "**Title:** T\n\n**Authors:** A\n\none\n\ntwo"
    assert parse_epub(b"no zip").blocks == [] and ZipArchive.open(b"PK") is None
    book = ZipArchive.open(_book())
    assert book.read("absent") is None and book.read_text("O/1.xhtml").startswith("<html>")
    offset, packed, method = book.entries["O/2.xhtml"]
    for cut in ((offset, packed - 3, method), (offset, 10**6, method), (offset, packed, 99)):
        book.entries["O/2.xhtml"] = cut
        assert book.read("O/2.xhtml") is None


def test_png_decodes():
    pixels = bytes(range(7 * 5 * 4))
    found, at, body = encode_png(7, 5, pixels), 8, b""
    while at < len(found):
        n, kind = struct.unpack_from(">I4s", found, at)
        body += found[at + 8 : at + 8 + n] * (kind == b"IDAT")
        assert zlib.crc32(found[at + 4 : at + 8 + n]) == struct.unpack_from(">I", found, at + 8 + n)[0]
        at += 12 + n
    rows = zlib.decompress(body)
    assert b"".join(rows[i + 1 : i + 29] for i in range(0, len(rows), 29)) == pixels
    assert encode_png(0, 4, b"") is None and encode_png(2, 2, b"1") is None


def test_dispatch_and_failures(spark):
    rows = [("a.md", b"# x\r\n\n\n\ny  \n"), ("x.txt", b"%PDF 1"), ("d\\e.HTML", b"<p>p"), ("b.csv", b"PK,1\n"), ("z.docx", b"PK"), ("noext", b"q"), ("bad.json", None), ("own.q", b"1")]
    df = spark.createDataFrame(rows, "path string, content binary")

    def broken(content, base):
        raise ValueError("no")

    registry = Registry().register(Converter("own", ("q",), (), broken))
    found = {r["path"]: r for r in ops.convert(df, registry=registry).collect()}
    assert found["a.md"]["markdown"] == "# x\n\ny" and found["x.txt"]["converter"] == "text" and found["d\\e.HTML"]["markdown"] == "p"
    assert found["b.csv"]["markdown"] == "| PK | 1 |\n| --- | --- |" and found["b.csv"]["detected"]["mimetype"] == "application/zip"
    assert found["z.docx"]["error"]["message"] == "No converter found for: docx" and found["noext"]["error"]["message"] == "No converter found for: unknown"
    assert found["own.q"]["error"]["message"] == "Conversion failed with ValueError: no"
    pdf = Registry().with_pdf(lambda b: b.decode()[4:])
    assert ops.convert(df.where("path = 'x.txt'"), registry=pdf).first()["converter"] == "pdf"


def test_tables_of_node_table(spark):
    df = spark.createDataFrame([(1, b"a,b\n1,2\n3\n")], "id long, content binary").withColumn("path", F.lit("t.csv"))
    nodes = ops.node_table(ops.convert(df, tree=True), "id")
    assert [r["body_rows"] for r in ops.tables(nodes, "id").collect()] == [2]
    assert nodes.where("kind = 'table_cell'").count() == 5


def test_stream(spark, tmp_path):
    from folium.sources.files import read_documents
    from folium.streaming.convert import convert_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.html").write_text("<p>x")
    q = convert_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination(60)
    assert [r["markdown"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["x"]
    assert read_documents(spark, str(tmp_path / "in")).count() == 1


def test_render_and_titles_go_on_past_a_failure(spark):
    bad = [{"kind": "no such kind", "parent_id": -1, "node_id": 0, "depth": 0, "ordinal": 0, "slot": "block"}]
    df = spark.createDataFrame([(1, to_nodes([paragraph([text("a")])])), (2, bad), (3, None)], T.StructType([T.StructField("id", T.LongType()), T.StructField("nodes", T.ArrayType(NODE))]))
    found = {r["id"]: (r["markdown"], r["render_error"] is None) for r in ops.render(df).collect()}
    assert found == {1: ("a", True), 2: (None, False), 3: (None, True)}
    titles = ops.titles(spark.createDataFrame([(1, "<title>t</title>"), (2, None), (3, "<div>" * 3000)], "id long, html string")).collect()
    assert {r["id"]: r["title"] for r in titles} == {1: "t", 2: None, 3: None}


def test_convert_options(spark):
    df = spark.createDataFrame([("a.html", b"<h1>t</h1><p>x", "mine")], "path string, content binary, title string")
    tree = ops.convert(df, tree=True, markdown=False)
    assert "markdown" not in tree.columns and tree.first()["title"] == "t" and [n["kind"] for n in tree.first()["nodes"]] == ["heading", "text", "paragraph", "text"]
    assert [n.asDict() for n in tree.first()["nodes"]] == to_nodes(html_document("<h1>t</h1><p>x").blocks)
    own = ops.convert(df, detector=lambda path, content: C.detect(F.lit("x.txt"), content)).first()
    assert own["converter"] == "text" and own["markdown"] == "<h1>t</h1><p>x"
    with pytest.raises(Exception, match="No converter found"):
        ops.convert(df.withColumn("path", F.lit("a.zzz")), failures="raise").collect()


def test_markdown_to_files(spark, tmp_path):
    from folium.sources.files import write_markdown

    df = spark.createDataFrame([("b.md", "# x\n\ny"), ("c d.md", "z")], "path string, markdown string").withColumns({"title": F.lit(None).cast("string"), "error": F.lit(None).cast("string")})
    write_markdown(df, str(tmp_path / "text"), format="text")
    files = {f.name: f.read_text() for f in (tmp_path / "text").rglob("*") if f.is_file()}
    assert files == {"b.md.md": "# x\n\ny", "c%20d.md.md": "z"}
    with pytest.raises(FileExistsError):
        write_markdown(df, str(tmp_path / "text"), format="text")
    write_markdown(df, str(tmp_path / "parquet"))
    assert spark.read.parquet(str(tmp_path / "parquet")).count() == 2


def test_report_and_gate(spark, tmp_path):
    rows = [("f", "a", "# one words\n- listed\n"), ("f", "b", "# one words\n| x |\n| - |\n| 1 | 2 |\n"), ("g", "a", "")]
    measured = corpus.measures(spark.createDataFrame(rows, "file string, engine string, markdown string"))
    got = {(r["file"], r["engine"]): r for r in measured.collect()}
    assert got["f", "a"]["recall"] == 1.0 and got["f", "a"]["unique_tokens"] == 1 and got["g", "a"]["recall"] == 1.0 and got["f", "b"]["broken_rows"] == 1
    corpus.write_report(measured, str(tmp_path / "report"))
    text_ = "".join(f.read_text() for f in sorted((tmp_path / "report").glob("part-*.txt")))
    assert text_.startswith("## f\n\n| engine | recall |") and text_.index("## g") < text_.index("## Totals") and "| a | 2 | 100.0% | 1 | 0 | 0 | 0 | 0 |" in text_
    pairs = spark.createDataFrame([(1, "Kept words – all", "words kept-all"), (2, "lost token", "token")], "id long, r string, a string")
    assert [(r["id"], r["similarity"], r["missing"]) for r in corpus.recall_gate(pairs, "id", "r", "a").collect()] == [(2, 0.5, ["lost"])]
