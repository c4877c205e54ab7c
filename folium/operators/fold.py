"""Markdown from the node table as a relational fold: level by level from the leaves up, in Catalyst alone.

A level is joined with its children, grouped by parent; a node becomes inline text or a list of lines. A quote or an item puts its prefix before the lines of its blocks, so no line is
looked at again but to be prefixed. Nodes are exchanged once, by document, in as many parts as they fill; all levels of a document are then folded where they lie, by sorts that can spill.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folium.functions import columns as C
from folium.model import NODE, MarkdownOptions
from folium.operators.stage import parts, written
from folium.text import SPACE

#: Levels of one plan; deeper trees write what they have so far and go on from there.
LEVELS = 8
#: So many nodes of all levels are one task's, or one document's nodes if it has more.
TASK_NODES = 1_000_000
_LINE_END = r"\r\n|\n|\r"
# The fields of a node that its Markdown is made of.
USED = frozenset("parent_id slot ordinal kind text level language ordered start loose checked col_span alignments url link_title".split())
#: Kinds whose Markdown is made of their own fields alone, before they are written. Below the top they go to their parent at once, without a group of their own.
LEAVES = ("text", "line_break", "code_span", "image", "raw_inline", "code_block", "thematic_break", "html_comment", "raw_block")
#: What escaping may change.
_MARKUP = r"[\\*`\[\]_<&|#>=+\-.)\r]"
#: What a node hands to its parent: inline text where a line begins, within a line and within a table cell if it differs there; lines of a block; cells of a row.
_VALUE = "struct<start:string,inner:string,cell:string,lines:array<string>,cells:array<string>>"


def _value(start=None, inner=None, cell=None, lines=None, cells=None) -> Column:
    parts = {"start": start, "inner": inner, "cell": cell, "lines": lines, "cells": cells}
    return F.struct(*[(F.lit(None) if v is None else v).alias(k) for k, v in parts.items()]).cast(_VALUE)


def _same(text: Column, cell: Column | None = None) -> Column:
    return _value(text, cell=cell)


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _collapsed(text: Column) -> Column:
    return C.trimmed(F.array_join(F.transform(F.split(text, _LINE_END), C.trimmed), " "))


def _rows(text: Column) -> Column:
    """Lines; none of an empty text."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, "\n"))


def _of(slot: str, field: str) -> Column:
    """The children of a slot in order: that field of their values."""
    return F.transform(F.filter("kids", lambda k: k["slot"] == slot), lambda k: k[field])


def _joined(field: str, *kinds: str) -> Column:
    """For nodes of these kinds; those of others have no use for it."""
    return F.when(F.col("kind").isin(*kinds), F.coalesce(F.array_join(F.col("kids")[field], ""), F.lit("")))


def _held() -> Column:
    """Lines of the blocks that a node holds; of a single one as they are."""
    only = F.get("kids", F.lit(0))
    return F.when((F.size("kids") == 1) & (only["slot"] == "block"), F.coalesce(only["lines"], F.array().cast("array<string>"))).otherwise(_stacked(_of("block", "lines")))


def _stacked(blocks: Column) -> Column:
    """Lines of blocks with an empty line between those that have any.

    Where a block without lines follows an empty quote or item, its separator leaves a bare line behind, which takes no prefix: null."""
    none = F.array().cast("array<string>")
    before = F.slice(F.concat(F.array(none), blocks), F.lit(1), F.size(blocks))
    bare = lambda p: F.coalesce(F.get(p, F.size(p) - 1).rlike(r"[ \t]\z"), F.lit(False))
    led = F.zip_with(
        blocks, before, lambda x, p: F.when(F.size(x) > 0, F.concat(F.array(F.lit("")), x)).when(bare(p), F.array(F.lit(None).cast("string"))).otherwise(none)
    )
    return F.slice(F.flatten(led), F.lit(2), F.lit(1 << 30))


def _led(lines: Column, first: Column, others: Column) -> Column:
    """A prefix for the first line and one for those behind it; without lines the first prefix alone."""
    led = F.transform(lines, lambda x, i: F.concat(F.when(i == 0, first).otherwise(others), x))
    return C.let(led, lambda found: F.when(F.size(found) > 0, found).otherwise(F.array(first)))


def _escaped(text: Column, o: MarkdownOptions) -> Column:
    if o.escape_text:
        escaped = _value(C.escape(text), C.escape(text, line_start=False), C.escape(text, table=True, line_start=False))
        return F.when(text.rlike(_MARKUP), escaped).otherwise(_same(text))
    plain = F.regexp_replace(text, r"\r\n?", "\n")
    return _same(plain, F.replace(plain, F.lit("|"), F.lit(r"\|")))


def _marked(inner: Column, mark: Column) -> Column:
    """The mark hugs the text; blanks at either edge stay outside."""
    core = C.trimmed(inner)
    before = F.length(inner) - F.length(F.ltrim(inner, F.lit(SPACE)))
    after = F.rtrim(inner, F.lit(SPACE))
    return F.when(core == "", inner).otherwise(
        F.concat(F.substring(inner, F.lit(1), before), mark, core, mark, F.substring(inner, F.length(after) + 1, F.length(inner)))
    )


def _titled() -> Column:
    return F.coalesce(F.concat(F.lit(' "'), F.replace("link_title", F.lit('"'), F.lit('\\"')), F.lit('"')), F.lit(""))


def _width(text: Column) -> Column:
    """In UTF-16 units."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def _inlines(o: MarkdownOptions) -> dict[str, Column]:
    inner, in_cell, url = F.col("inner"), F.col("in_cell"), _text("url")
    label = _collapsed(inner)
    link = F.concat(F.lit("["), F.when(label == "", url).otherwise(label), F.lit("]("), C.encode_url(url), _titled(), F.lit(")"))
    alt = F.replace(F.replace(_text("text"), F.lit("\n"), F.lit(" ")), F.lit("]"), F.lit("\\]"))
    shown = F.lit(not o.images_as_text) & (C.trimmed(url) != "") & (_width(url) <= o.max_inline_image_url)
    image = F.when(shown, F.concat(F.lit("!["), alt, F.lit("]("), C.encode_url(url), _titled(), F.lit(")"))).otherwise(F.when(C.trimmed(alt) == "", "").otherwise(alt))
    marks = {"strong": o.strong_marker, "emphasis": o.emphasis_marker, "strikethrough": "~~"}
    return {
        "text": _escaped(_text("text"), o), "line_break": _same(F.lit("\\\n"), F.lit(" ")), "code_span": _same(C.code_span(_text("text"))), "link": _same(link),
        "image": _same(image), "raw_inline": _same(_text("text"))
    } | {kind: _same(_marked(inner, F.lit(m)), _marked(in_cell, F.lit(m))) for kind, m in marks.items()}


def _table(o: MarkdownOptions) -> Column:
    header, rows = F.flatten(_of("header", "cells")), _of("row", "cells")
    n = F.greatest(F.size(header), F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(0)))
    all_rows = F.transform(F.concat(F.array(header), rows), lambda r: C.padded(r, n))
    aligned = F.slice(F.concat(F.coalesce("alignments", F.array().cast("array<string>")), F.array_repeat(F.lit("NONE"), n)), F.lit(1), n)
    if o.pad_table_columns:
        widest = F.transform(aligned, lambda _, i: F.greatest(F.lit(3), F.array_max(F.transform(all_rows, lambda r: _width(F.get(r, i))))))
        fill = lambda c, w: F.concat(c, F.repeat(F.lit(" "), w - _width(c)))
        all_rows = F.transform(all_rows, lambda r: F.transform(r, lambda c, i: fill(c, F.get(widest, i))))
    else:
        widest = F.transform(aligned, lambda _: F.lit(3))
    dashes = lambda k: F.repeat(F.lit("-"), k)
    rule = F.zip_with(
        aligned, widest, lambda a, w: F.when(a == "LEFT", F.concat(F.lit(":"), dashes(w - 1))).when(a == "RIGHT", F.concat(dashes(w - 1), F.lit(":")))
        .when(a == "CENTER", F.concat(F.lit(":"), dashes(w - 2), F.lit(":"))).otherwise(dashes(w))
    )
    lines = F.transform(F.concat(F.slice(all_rows, 1, 1), F.array(rule), F.slice(all_rows, F.lit(2), F.size(all_rows))), C.table_row)
    mark = F.lit(o.emphasis_marker)
    caption = F.when(F.exists("kids", lambda k: k["slot"] == "caption"), F.array(F.lit(""), F.concat(mark, _collapsed(F.col("inner")), mark)))
    return F.when(n > 0, F.concat(lines, F.coalesce(caption, F.array().cast("array<string>")))).otherwise(F.array().cast("array<string>"))


def _blocks(o: MarkdownOptions) -> dict[str, Column]:
    inner, text = F.col("inner"), _text("text")
    head, body = _collapsed(inner), F.rtrim(inner, F.lit(SPACE))
    fence = F.repeat(F.lit("`"), F.greatest(F.lit(3), C.longest_run(text) + 1))
    code = F.concat(F.array(F.concat(fence, _text("language"))), F.split(F.rtrim(text, F.lit("\n")), "\n"), F.array(fence))
    raw = C.trimmed(F.regexp_replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), r"\n{3,}", "\n\n"))
    box = F.when(F.col("checked"), "[x] ").when(~F.col("checked"), "[ ] ").otherwise("")
    loose = F.coalesce("loose", F.lit(False))

    def item(lines: Column, i: Column) -> Column:
        number = F.concat((F.coalesce("start", F.lit(1)) + i).cast("string"), F.lit(". "))
        marker = F.when(F.coalesce("ordered", F.lit(False)), number).otherwise(f"{o.bullet} ")
        led = _led(lines, marker, F.repeat(F.lit(" "), F.length(marker)))
        return F.when(loose & (i > 0), F.concat(F.array(F.lit("")), led)).otherwise(led)

    none = F.array().cast("array<string>")
    cell = F.when(F.exists("kids", lambda k: k["slot"] == "inline"), F.col("in_cell")).otherwise(F.coalesce(_escaped(text, o)["cell"], _escaped(text, o)["start"]))
    cell = C.trimmed(F.array_join(F.transform(F.split(cell, _LINE_END), C.trimmed), o.table_cell_line_break))
    return {
        "heading": _value(lines=F.when(head == "", none).otherwise(F.array(C.heading(F.col("level"), head, o.max_heading_level)))),
        "paragraph": _value(lines=_rows(body)), "code_block": _value(lines=code),
        "block_quote": _value(lines=_led(_held(), F.lit("> "), F.lit("> "))),
        "list": _value(lines=F.flatten(F.transform(_of("item", "lines"), item))),
        "list_item": _value(lines=_led(_held(), box, F.lit(""))), "thematic_break": _value(lines=F.array(F.lit("---"))),
        "html_comment": _value(lines=F.array(F.concat(F.lit("<!-- "), C.trimmed(text), F.lit(" -->")))), "raw_block": _value(lines=_rows(raw)), "table": _value(lines=_table(o)),
        "table_row": _value(cells=F.flatten(_of("cell", "cells"))),
        "table_cell": _value(cells=F.concat(F.array(cell), F.array_repeat(F.lit(""), F.greatest(F.coalesce("col_span", F.lit(1)) - 1, F.lit(0)))))
    }


def _grouped(values: DataFrame, by: list[str], *more: Column) -> DataFrame:
    """kids of each parent, in order; each with the text that it adds to a run of inlines (inner) and to one in a cell (in_cell). A row without a value is no kid."""
    before = Window.partitionBy(*by).orderBy("slot", "ordinal").rowsBetween(Window.unboundedPreceding, -1)
    # a line begins at the first text and after one that ends a line; empty ones count not
    ends = F.when(F.col("value.start") != "", F.endswith("value.start", F.lit("\n")))
    begins = F.coalesce(F.last(ends, ignorenulls=True).over(before), F.lit(True))
    part = F.when(begins, F.col("value.start")).otherwise(F.coalesce("value.inner", "value.start"))
    inline = lambda text: F.when(F.col("slot").isin("inline", "caption"), text)
    kid = F.struct("slot", "ordinal", inline(part).alias("inner"), inline(F.coalesce("value.cell", "value.start")).alias("in_cell"), "value.lines", "value.cells")
    kid = F.when(F.col("value").isNotNull(), kid)
    return values.withColumn("kid", kid).groupBy(*by).agg(F.sort_array(F.collect_list("kid")).alias("kids"), *more)


def _filled(df: DataFrame) -> DataFrame:
    """df with the fields of a node that it lacks: null."""
    return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in NODE.fields if f.name in USED and f.name not in df.columns})


def _node_value(o: MarkdownOptions, leaves: bool) -> Column:
    """The value of a leaf of its fields, or of any other node of its fields and kids."""
    value = None
    for kind, made in (_inlines(o) | _blocks(o)).items():
        if (kind in LEAVES) == leaves:
            value = F.when(F.col("kind") == kind, made) if value is None else value.when(F.col("kind") == kind, made)
    return value


def _level(nodes: DataFrame, below: DataFrame | None, o: MarkdownOptions) -> DataFrame:
    """key, parent_id, slot, ordinal and value of the nodes of one level; nodes has the leaves of the level below as well."""
    if below is None:
        empty = "array<struct<slot:string,ordinal:int,inner:string,in_cell:string,lines:array<string>,cells:array<string>>>"
        given = nodes.withColumn("kids", F.array().cast(empty))
    else:
        # a node is brought under its own number beside what names it as parent: rows of both are where their document is, which a join by node would not know
        leaf, fields = F.col("leaf"), F.struct(*[c for c in nodes.columns if c in USED], "made")
        own = nodes.select(
            "key", F.when(leaf, F.col("parent_id")).otherwise(F.col("node_id")).alias("at"), *[F.when(leaf, F.col(c)).alias(c) for c in ("slot", "ordinal")],
            F.when(leaf, F.col("made")).alias("value"), F.when(~leaf, fields).alias("node")
        )
        kids = below.select("key", F.col("parent_id").alias("at"), "slot", "ordinal", "value", F.lit(None).cast(own.schema["node"].dataType).alias("node"))
        found = _grouped(own.unionAll(kids), ["key", "at"], F.first("node", ignorenulls=True).alias("node"))
        given = found.where("node is not null").select("key", "node.*", "kids")
    marks = ("strong", "emphasis", "strikethrough")
    given = _filled(given).withColumns({"inner": _joined("inner", *marks, "link", "heading", "paragraph", "table"), "in_cell": _joined("in_cell", *marks, "table_cell")})
    return given.select("key", "parent_id", "slot", "ordinal", F.coalesce("made", _node_value(o, leaves=False)).alias("value"))


def fold(nodes: DataFrame, key: str, options: MarkdownOptions | None = None, metadata: DataFrame | None = None) -> DataFrame:
    """key and markdown of every document of a node table (key and the fields of NODE; those that no node has may be left out); a document without nodes has no row.

    metadata: key and metadata (array of key, value) for the front matter, if the options ask for it. Nodes are written once, a folder for each level, and each row is read once."""
    o = options or MarkdownOptions()
    leaf, given = F.coalesce(F.col("kind").isin(*LEAVES), F.lit(False)), nodes.withColumnRenamed(key, "key")
    made = _filled(given).withColumns({"made": _node_value(o, leaves=True), "text": F.when(~leaf, F.col("text")), "leaf": leaf & (F.col("depth") > 0)})
    table = written(made.select("key", "node_id", "depth", *[c for c in given.columns if c in USED], "made", "leaf"), "nodes", "depth", "leaf")
    deepest = table.agg(F.max("depth")).first()[0]
    below, n, at = None, parts(table, TASK_NODES), F.col("depth")
    for depth in range(-1 if deepest is None else deepest, -1, -1):
        # the leaves of the deepest level are its own, others are read with the level of their parents
        here = (at == depth) & (~F.col("leaf") | (at == deepest)) | (at == depth + 1) & F.col("leaf") & (at < deepest)
        # the only exchange: what follows is grouped, sorted and joined within documents
        below = _level(table.where(here).repartition(n, "key"), below, o)
        if depth and depth % LEVELS == 0:
            below = written(below, "level").repartition(n, "key")
    if below is None:
        return nodes.select(key, F.lit("").alias("markdown"))
    top = _grouped(below, ["key"])
    lines = F.transform(_stacked(_of("block", "lines")), lambda x: F.coalesce(F.rtrim(x, F.lit(" \t")), F.lit("")))
    out = top.select("key", C.trimmed(F.array_join(lines, "\n")).alias("markdown"))
    if o.front_matter and metadata is not None:
        pairs = F.coalesce("metadata", F.array().cast("array<struct<key:string,value:string>>"))
        known = metadata.select(F.col(key).alias("key"), "metadata")
        out = out.join(known, "key", "left").select("key", C.front_matter(pairs, F.col("markdown")).alias("markdown"))
    return out.withColumnRenamed("key", key)
