"""Hand-made cases of parsers and renderer: what goes in and the Markdown that must come out. ``{n}`` stands for a word of plain letters.

The queries run them over the rows of a table, the tests once each."""

from __future__ import annotations

from collections.abc import Callable

from folium.model import Document, DocumentBuilder, InlineBuilder, MarkdownOptions, Node, node, paragraph, plain_cell, styled, table, text


def _items(*items: list[Node], checked: list[bool | None] | None = None, **fields) -> Node:
    marks = checked or [None] * len(items)
    return node("list", items=[node("list_item", blocks=b, checked=c) for b, c in zip(items, marks)], **fields)


def _p(value: str) -> Node:
    return paragraph([text(value)])


def _cell(*content: Node, **fields) -> Node:
    return node("table_cell", content=list(content), **fields)


def _build(n: str) -> Document:
    b = DocumentBuilder().title_if_absent(" ").title_if_absent(n).title_if_absent("other").meta("blank", " ").meta("name", n)
    b.heading(2, n).heading(1, " ").paragraph("").paragraph(
        [text(n), node("line_break"), text("next")]
    ).code("", "py").comment(" c ").raw(" ").raw(f"*{n}*").bullet_list(["a", " ", "b"]).bullet_list([])
    return b.table(["h"], [["1"], ["2"]], ["RIGHT"]).table([], []).build()


def _inlines(n: str) -> list[Node]:
    b = InlineBuilder().text("").text(n).text(" ").strong("s").text(" ").emphasis("").emphasis("e").text(" ").code("c").text(" ").link("", "u").line_break()
    b += node("raw_inline", text="<hr>")
    return b.content


#: part -> (document of a word, its Markdown, options)
RENDERED: dict[str, tuple[Callable[[str], Document], str, MarkdownOptions | None]] = {
    "heading": (
        lambda n: Document(
            [node("heading", level=9, content=[text(f"{n}\r\n\n # b")]), node("heading", level=1, content=[text("  ")]), _p("after")]
        ),
        "###### {n}  \\# b\n\nafter", None
    ),
    "heading_limit": (lambda n: Document([node("heading", level=4, content=[text(n)])]), "## {n}", MarkdownOptions(max_heading_level=2)),
    "paragraph": (lambda n: Document([_p(f"{n} \n\tb \t\n c  ")]), "{n}\n\tb\n c", None),
    "code": (lambda n: Document([node("code_block", text=f"{n}```` \n\n", language="md")]), "`````md\n{n}````\n`````", None),
    "quote": (
        lambda n: Document([node("block_quote", blocks=[_p(n), node("block_quote", blocks=[_p("a\nb")]), _p("c")])]),
        "> {n}\n>\n> > a\n> > b\n>\n> c", None
    ),
    "quote_empty": (lambda n: Document([_p(n), node("block_quote", blocks=[]), _p("b")]), "{n}\n\n>\n\nb", None),
    "list_ordered": (
        lambda n: Document([_items([_p(n)], [_p("b"), _items([_p("c")], ordered=False), _p("d\ne")], ordered=True, start=9)]),
        "9. {n}\n10. b\n\n    - c\n\n    d\n    e", None
    ),
    "list_loose": (
        lambda n: Document([_items([_p(n)], [_p("b\nc")], [], ordered=False, loose=True, checked=[True, False, None])]),
        "* [x] {n}\n\n* [ ] b\n  c\n\n*", MarkdownOptions(bullet="*")
    ),
    "list_quote_code": (
        lambda n: Document([_items([node("block_quote", blocks=[node("code_block", text=f"{n}\n\n x")])], ordered=False)]),
        "- > ```\n  > {n}\n  >\n  >  x\n  > ```", None
    ),
    "table": (
        lambda n: Document(
            [
                table(
                    [plain_cell(f"{n}|1"), plain_cell("b")],
                    [[plain_cell("c")], [node("table_cell", text="d", col_span=3), plain_cell("e")]], ["LEFT", "RIGHT", "CENTER"]
                )
            ]
        ),
        "| {n}\\|1 | b |  |  |\n| :-- | --: | :-: | --- |\n| c |  |  |  |\n| d |  |  | e |", None
    ),
    "table_cells": (
        lambda n: Document(
            [
                table(
                    [],
                    [
                        [
                            _cell(text("\na \r\n b\r"), text(n)), _cell(node("link", content=[text("x|y")], url="u|v")),
                            _cell(node("link", content=[text("#1")], url="u")), _cell(text("# - 1. <br>"))
                        ]
                    ]
                )
            ]
        ),
        "|  |  |  |  |\n| --- | --- | --- | --- |\n| <br>a<br>b<br>{n} | [x|y](u|v) | [\\#1](u) | # - 1. \\<br> |", None
    ),
    "table_break": (
        lambda n: Document([table([_cell(text(n), node("line_break"), text("b"))], [[plain_cell("c\nd")]])]),
        "| {n} b |\n| --- |\n| c / d |", MarkdownOptions(table_cell_line_break=" / ")
    ),
    "table_caption": (
        lambda n: Document(
            [
                table([plain_cell("h")], [], caption=[text(f"{n}\nb ")]), table([plain_cell("i")], [], caption=[text(" ")]),
                table([], [], caption=[text("none")])
            ]
        ),
        "| h |\n| --- |\n\n_{n} b_\n\n| i |\n| --- |\n\n__", MarkdownOptions(emphasis_marker="_")
    ),
    "table_padded": (
        lambda n: Document([table([plain_cell("name"), plain_cell("b")], [[plain_cell("c"), plain_cell("😀")]], ["CENTER"])]),
        "| name | b   |\n| :--: | --- |\n| c    | 😀  |", MarkdownOptions(pad_table_columns=True)
    ),
    "rule_comment_raw": (
        lambda n: Document(
            [node("thematic_break"), node("html_comment", text=f" {n} "), node("raw_block", text=f"\r\n*{n}*  \n\n\n\n# x\r\n")]
        ),
        "---\n\n<!-- {n} -->\n\n*{n}*\n\n# x", None
    ),
    "marks": (
        lambda n: Document(
            [
                paragraph(
                    [
                        node("strong", content=[text(f" {n} ")]), node("emphasis", content=[text("  ")]),
                        node("strikethrough", content=[node("strong", content=[text("# x")])])
                    ]
                )
            ]
        ),
        "**{n}**   ~~**\\# x**~~", None
    ),
    "mark_options": (
        lambda n: Document([paragraph(styled([text(n)], True, True, True))]), "__*~~{n}~~*__", MarkdownOptions(strong_marker="__")
    ),
    "code_span": (lambda n: Document([paragraph([node("code_span", text=f"`{n}\nb``")])]), "``` `{n} b`` ```", None),
    "link": (
        lambda n: Document(
            [
                paragraph(
                    [
                        node("link", content=[text(f"{n}\n b")], url="a b(c)", link_title='q"r'),
                        node("link", content=[text(" ")], url="u|v", link_title="")
                    ]
                )
            ]
        ),
        '[{n} b](a%20b%28c%29 "q\\"r")[u|v](u|v "")', None
    ),
    "image": (
        lambda n: Document(
            [
                paragraph(
                    [
                        node("image", text=f"{n}]\nb", url="u (1)", link_title="t"), node("image", text=" ", url=" "),
                        node("image", text="alt", url="")
                    ]
                )
            ]
        ),
        '![{n}\\] b](u%20%281%29 "t")alt', None
    ),
    "image_text": (
        lambda n: Document([paragraph([text("a "), node("image", text=n, url="u"), node("image", text=" ", url="u")])]), "a {n}",
        MarkdownOptions(images_as_text=True)
    ),
    "image_long": (
        lambda n: Document([paragraph([node("image", text=n, url="longer"), node("image", text="b", url="short")])]), "{n}![b](short)",
        MarkdownOptions(max_inline_image_url=5)
    ),
    "escapes": (
        lambda n: Document(
            [_p(f"# {n}\n> a\n= b\n- c\n-d\n+ e\n1. f\n12) g\n1.h\n  - i\na_b _c_ d_\n<a <1 </ <! & &amp; &#12; &waytoolong; *[x]`\\|")]
        ),
        "\\# {n}\n\\> a\n\\= b\n\\- c\n-d\n\\+ e\n1\\. f\n12\\) g\n1.h\n  \\- i\na_b \\_c\\_ d\\_\n\\<a <1 \\</ \\<! & \\&amp; \\&#12; &waytoolong; \\*\\[x\\]\\`\\\\|",
        None
    ),
    "no_escapes": (
        lambda n: Document([_p(f"# *{n}*"), table([plain_cell("a|*b*")], [])]), "# *{n}*\n\n| a\\|*b* |\n| --- |",
        MarkdownOptions(escape_text=False)
    ),
    "front_matter": (
        lambda n: Document([_p(n)], metadata={"title": f"{n}\nb", "z": "1"}), "---\ntitle: {n} b\nz: 1\n---\n\n{n}",
        MarkdownOptions(front_matter=True)
    ),
    "builder": (
        _build,
        "---\nname: {n}\n---\n\n## {n}\n\n{n}\\\nnext\n\n```py\n\n```\n\n<!-- c -->\n\n*{n}*\n\n- a\n-\n- b\n\n| h |\n| --: |\n| 1 |\n| 2 |",
        MarkdownOptions(front_matter=True)
    ),
    "inline_builder": (lambda n: Document([paragraph(_inlines(n))]), "{n} **s** *e* `c` [u](u)\\\n<hr>", None),
}

#: part -> (HTML of a word, its Markdown)
HTML: dict[str, tuple[str, str]] = {
    "drop_first": (
        "<pre>{n}<button>Copy</button></pre><p><code>a<script>bad()</script></code><svg><title>icon</title>x</svg></p><form><p>f</p></form><select><option>s</select>",
        "```\n{n}\n```\n\n`a`"
    ),
    "containers": (
        "<main>{n}<section>b<figure>c<figcaption>d</figcaption></figure></section>e</main><address>f</address>g<dialog>h</dialog>",
        "{n}\n\nb\n\nc\n\n*d*\n\ne\n\nfgh"
    ),
    "heading": ("<h3 id=x> {n} <b>b</b></h3><h2> </h2>", "### {n} **b**"),
    "lists": ("<ol start=7><li>{n}<li><p>b</p><ul><li>c</ul><li> </ol><ol start=x><li>d</ol>", "7. {n}\n8. b\n\n   - c\n\n1. d"),
    "pre": ("<pre>\n a\n  {n} \n\n</pre><pre><code class='x lang-py'>b</code></pre>", "```\n a\n  {n}\n```\n\n```py\nb\n```"),
    "quote": ("<blockquote>{n}<blockquote>b</blockquote></blockquote><blockquote> </blockquote>", "> {n}\n>\n> > b"),
    "definitions": ("<dl><dt>{n}<dd>b<dt> <div>x</div></dl>", "**{n}**\n\nb\n\n**x**"),
    "table": (
        "<table><caption> {n} </caption><tr><th>a<th colspan=2>b<tr><td>1<td>2<td>3<tr><td rowspan=2>4</table>",
        "| a | b |  |\n| --- | --- | --- |\n| 1 | 2 | 3 |\n| 4 |  |  |\n\n*{n}*"
    ),
    "table_no_header": (
        "<table><tr><th>{n}<td>b<tr><th>c</table><table><tr></tr><tr><th>late</table>",
        "|  |  |\n| --- | --- |\n| {n} | b |\n| c |  |\n\n|  |\n| --- |\n| late |"
    ),
    "table_nested": ("<table><tr><td>{n}<table><tr><td>in</table><td>b</table>", "|  |  |\n| --- | --- |\n| {n}in | b |"),
    "links": (
        "<p>a<a href='x'> </a>b <a href=' '>c</a><a href='javascript:y'>d</a><a href='u v' title='t'> {n} </a><a name=z>e</a>",
        'ab cd[{n}](u%20v "t")e'
    ),
    "images": ("<p><img src=' '><img src=u alt={n}><img alt=b><img src=v title=t></p>", '![{n}](u)![](v "t")'),
    "code": ("<p>a<code> {n} </code>b<code> </code><kbd>k</kbd><samp>s</samp><tt>t`</tt>", "a`{n}`b`k``s``` t` ``"),
    "marks": (
        "<p>a<b> </b>b<i> {n} </i>c<em></em><s>d</s><strike>e</strike><del>f</del><cite>g</cite><var>h</var><u>i</u>",
        "ab *{n}* c~~d~~~~e~~~~f~~*g**h*i"
    ),
    "breaks": ("{n}<br>b<p>c<br></p>", "{n}\\\nb\n\nc\\"),
    "blanks": ("<p>  a \n\t{n}&nbsp; b <!-- c --> d  </p> \n <div> </div>", "a {n}\u00a0 b  d"),
    "misnested": ("<b>1<p>{n}</b>3</p>", "**1**\n\n**{n}**3"),
    "foster": ("<table>x<tr><td>{n}</table>", "x\n\n|  |\n| --- |\n| {n} |"),
    "entities": ("<p>&lt;{n}&gt; &amp;amp; &copy; &#65;", "\\<{n}> \\&amp; © A"),
}

#: part -> (extension, text of a word, its Markdown)
OTHERS: dict[str, tuple[str, str, str]] = {
    "csv": ("csv", 'a,b\r\n\r\n{n}\n"x ""y""\nz", |q ,\n', "| a | b |  |\n| --- | --- | --- |\n| {n} |  |  |\n| x \"y\"<br>z | \\|q |  |"),
    "json": (
        "json", '{"{n}":[1.50,{},[ ],"a\\"b"],"c":{"d":null}} ',
        '```json\n{\n    "{n}": [\n        1.50,\n        {},\n        [],\n        "a\\"b"\n    ],\n    "c": {\n        "d": null\n    }\n}\n```'
    ),
    "json_broken": ("json", '{"{n}":"x\\"', '```json\n{"{n}":"x\\"\n```'),
    "json_comma": ("json", "[1, {n},", "```json\n[1, {n},\n```"),
    "json_open": ("json", '{"{n}":[', '```json\n{\n    "{n}": [\n\n```'),
    "xml": (
        "xml", '<?xml version="1.0"?><!DOCTYPE r><r a="1"><k/><v>{n}</v><w>two\nlines</w><e></e>t</r>',
        '```xml\n<!DOCTYPE r>\n<r a="1">\n  <k/>\n  <v>{n}</v>\n  <w>\n    two\nlines\n  </w>\n  <e>\n  </e>\n  t\n</r>\n```'
    ),
    "xml_none": ("xml", "{n} < no tags", "```xml\n{n} < no tags\n```"),
    "text": ("txt", "\r\n{n}  \n\n\n\n # b\r\n", "{n}\n\n # b"),
    "markdown": ("md", "# {n}\n\n\n\n*b*  ", "# {n}\n\n*b*"),
}

#: part -> (text, its paragraphs once wrapped lines are joined)
REFLOWED: dict[str, tuple[str, str]] = {
    "lines": ("{n}\r\n b \n \t\nc\fd", "{n} b\n\nc d"),
    "hyphen_known": ("well-\nknown {n} well known", "well-known {n} well known"),
    "hyphen_dropped": ("{n} x-\nample", "{n} xample"),
    "hyphen_over_paragraphs": ("{n} be-\n\nginn", "{n} be-ginn"),
    "dash_alone": ("{n} -\nb", "{n} - b"),
}

#: part -> (text as an extractor leaves it, repaired)
REPAIRED: dict[str, tuple[str, str]] = {
    "joined": ("con\ufffefir\ufffeming {n}", "confirming {n}"),
    "kept": ("chat\ufffeoptimized {n} chat optimized", "chat-optimized {n} chat optimized"),
    "halves": ("{n}\ufffeand \ufffe and", "{n}and  and"),
}
