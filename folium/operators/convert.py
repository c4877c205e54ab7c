"""Documents in DataFrames: detect, parse, render, and the node table.

Detection and dispatch are Column expressions. Markdown and plain text are converted by Catalyst alone; other formats run in one
Arrow-batched Python function, in which parsing and rendering are one step. A document that fails has an error and no Markdown;
failures="raise" ends the job instead.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folium.functions import columns as C
from folium.model import ASSET, ERROR, NODE, PAIR, Document, MarkdownOptions, from_nodes, node_rows
from folium.plans.registry import Registry
from folium.render import render as render_document

NATIVE = ("markdown", "text")
Detector = Callable[[Column, Column], Column]
INFO = "struct<mimetype:string,extension:string,filename:string>"
PARSED = T.StructType(
    [
        T.StructField("nodes", T.ArrayType(NODE)), T.StructField("title", T.StringType()), T.StructField("metadata", T.ArrayType(PAIR)),
        T.StructField("assets", T.ArrayType(ASSET)), T.StructField("markdown", T.StringType()), T.StructField("error", ERROR)
    ]
)


def dispatched(
    df: DataFrame, content: Column, path: Column | None = None, detected: Column | None = None, registry: Registry | None = None
) -> DataFrame:
    """df with detected, converter and error (kind ``unsupported`` where no converter accepts)."""
    found = detected if detected is not None else C.detect(path, content)
    df = df.withColumn("detected", found.cast(INFO))
    df = df.withColumn("converter", (registry or Registry()).select(F.col("detected")))
    message = F.concat(F.lit("No converter found for: "), F.coalesce("detected.extension", "detected.mimetype", F.lit("unknown")))
    return df.withColumn(
        "error", F.when(F.col("converter").isNull(), F.struct(F.lit("unsupported").alias("kind"), message.alias("message")))
    )


def _guarded(convert_one, what: str):
    """(result, error) of one document: its failure is its own."""
    try:
        return convert_one(), None
    except Exception as e:
        return None, {"kind": "conversion", "message": f"{what} failed with {type(e).__name__}: {e}"}


#: So much text is parsed or rendered at a time: what a document is in Python is many times larger than its text.
SLICE_BYTES = 1 << 20


def sliced(run: Callable[..., pa.Array], by: int = 0, max_bytes: int = SLICE_BYTES) -> Callable[..., pa.Array]:
    """run over slices of its arrays, of about max_bytes of the array number by; the Python objects of a slice are gone before the next."""

    def whole(*arrays: pa.Array) -> pa.Array:
        n, parts, at = len(arrays[0]), [], 0
        per_row = max(1, arrays[by].nbytes // max(1, n))
        step = max(1, max_bytes // per_row)
        while at < n or not parts:
            parts.append(run(*[a.slice(at, step) for a in arrays]))
            at += step
        return pa.concat_arrays(parts)

    return whole


def _worker(registry: Registry, options: MarkdownOptions, tree: bool, markdown: bool):
    parsers = {c.name: c.parse for c in registry.converters}

    def one(name: str, content: bytes | None, base: str | None) -> tuple[Document, str | None]:
        doc = parsers[name](content or b"", base or "")
        return doc, render_document(doc, options) if markdown else None

    def run(names: pa.Array, contents: pa.Array, bases: pa.Array) -> pa.Array:
        from pyspark.sql.pandas.types import to_arrow_type

        docs, made, errors = [], [], []
        for name, content, base in zip(names.to_pylist(), contents.to_pylist(), bases.to_pylist()):
            found, error = (None, None) if name is None else _guarded(lambda: one(name, content, base), "Conversion")
            doc, md = found or (None, None)
            docs.append(doc)
            made.append(md)
            errors.append(error)
        kind = to_arrow_type(PARSED)
        pairs = [[{"key": k, "value": v} for k, v in d.metadata.items()] if d and tree else None for d in docs]
        columns = {
            "nodes": node_lists(
                [d.blocks if d and tree else None for d in docs], kind.field("nodes").type
            ), "title": pa.array([d and d.title for d in docs], pa.string()),
            "metadata": pa.array(pairs, kind.field("metadata").type), "assets": pa.array(
                [d.assets if d and tree else None for d in docs], kind.field("assets").type
            ),
            "markdown": pa.array(made, pa.string()), "error": pa.array(errors, kind.field("error").type),
        }
        return pa.StructArray.from_arrays([columns[f.name].cast(f.type) for f in kind], fields=list(kind))

    return F.arrow_udf(sliced(run, by=1), PARSED)


def node_lists(trees: list[list | None], kind: pa.DataType) -> pa.Array:
    """Preorder lists as one Arrow array, built field by field."""
    rows, ends = [], [0]
    for tree in trees:
        if tree is not None:
            rows += node_rows(tree)
        ends.append(len(rows))
    struct = kind.value_type
    fields = list(zip(*rows)) or [()] * struct.num_fields
    values = pa.StructArray.from_arrays([pa.array(v, f.type) for v, f in zip(fields, struct)], fields=list(struct))
    missing = pa.array([t is None for t in trees], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, type=kind, mask=missing)


def convert(
    df: DataFrame, content: str = "content", path: str | None = "path", detected: Column | None = None, base_url: str | None = None, registry: Registry | None = None, options: MarkdownOptions | None = None,
    tree: bool = False, failures: str = "record", markdown: bool = True, detector: Detector | None = None,
) -> DataFrame:
    """df with detected, converter, markdown (unless turned off), title, error; with tree also nodes, metadata, assets. Columns of these names are replaced.

    detector: of the path (null without one) and the content, in place of the detection by signature and extension."""
    registry, options = registry or Registry(), options or MarkdownOptions()
    if detector is not None:
        detected = detector(F.col(path) if path else F.lit(None).cast("string"), F.col(content))
    df = dispatched(df, F.col(content), F.col(path) if path else None, detected, registry)
    native = F.col("converter").isin(*NATIVE) if not tree else F.lit(False)
    names = F.when(~native, F.col("converter"))
    # rows that Catalyst converts send nulls to Python
    parsed = _worker(registry, options, tree, markdown)(
        names, F.when(names.isNotNull(), F.col(content)), F.col(base_url) if base_url else F.lit(None).cast("string")
    )
    df = df.withColumn("__parsed", parsed)
    if markdown:
        df = df.withColumn("markdown", F.when(native, C.raw_block(C.decoded(F.col(content)))).otherwise(F.col("__parsed.markdown")))
    df = df.withColumn("title", F.col("__parsed.title")).withColumn("error", F.coalesce("error", "__parsed.error"))
    if tree:
        df = df.withColumns({c: F.col(f"__parsed.{c}") for c in ("nodes", "metadata", "assets")})
    if failures == "raise":
        of = "markdown" if markdown else "title"
        df = df.withColumn(of, F.when(F.col("error").isNotNull(), F.raise_error(F.col("error.message"))).otherwise(F.col(of)))
    return df.drop("__parsed")


RENDERED = T.StructType([T.StructField("markdown", T.StringType()), T.StructField("error", T.StringType())])


def render(df: DataFrame, nodes: str = "nodes", metadata: str | None = None, options: MarkdownOptions | None = None) -> DataFrame:
    """df with markdown from node lists, and render_error: why a list could not be rendered, else null."""
    options = options or MarkdownOptions()

    def run(lists: pa.Array, metas: pa.Array) -> pa.Array:
        out = []
        for n, m in zip(lists.to_pylist(), metas.to_pylist()):
            made, error = (None, None) if n is None else _guarded(
                lambda: render_document(Document(from_nodes(n), metadata={p["key"]: p["value"] for p in m or ()}), options), "Rendering"
            )
            out.append({"markdown": made, "error": error and error["message"]})
        return pa.array(out, pa.struct([("markdown", pa.string()), ("error", pa.string())]))

    meta = F.col(metadata) if metadata else F.lit(None).cast(T.ArrayType(PAIR))
    df = df.withColumn("__made", F.arrow_udf(sliced(run), RENDERED)(F.col(nodes), meta))
    return df.withColumn("markdown", F.col("__made.markdown")).withColumn("render_error", F.col("__made.error")).drop("__made")


def node_table(df: DataFrame, key: str, nodes: str = "nodes") -> DataFrame:
    """One row per node: key and the fields of NODE."""
    return df.select(key, F.explode(nodes).alias("n")).select(key, "n.*")


def tables(nodes: DataFrame, key: str) -> DataFrame:
    """key, node_id and body_rows of every table of a node table."""
    rows = nodes.where("kind = 'table_row'").groupBy(key, F.col("parent_id").alias("node_id")).agg(F.count(F.lit(1)).alias("body_rows"))
    return nodes.where("kind = 'table'").select(key, "node_id").join(rows, [key, "node_id"], "left").withColumn(
        "body_rows", F.coalesce("body_rows", F.lit(0))
    )


def closed_references(html: Column, loose: tuple[str, ...] = ()) -> Column:
    """HTML text in which only character references that end with a semicolon count, as in XML, and those of the names in loose.

    HTML also reads some without one (``&amp``, ``&quot``); each ampersand that begins none of those above becomes a reference itself."""
    kept = "|".join([r"(?:[A-Za-z][A-Za-z0-9]*|#[0-9]+|#[xX][0-9A-Fa-f]+);", *loose])
    return F.regexp_replace(html, f"&(?!{kept})", "&amp;")


def titles(df: DataFrame, html: str = "html", terminated: bool = False) -> DataFrame:
    """df with title of HTML text, without building blocks where a title element has one; null where the text cannot be parsed.

    terminated: only references that end with a semicolon count (``closed_references``)."""
    from folium.parsers.html_walk import html_title

    def run(sources: pa.Array) -> pa.Array:
        return pa.array([None if s is None else _guarded(lambda: html_title(s), "Conversion")[0] for s in sources.to_pylist()], pa.string())

    source = closed_references(F.col(html)) if terminated else F.col(html)
    return df.withColumn("title", F.arrow_udf(sliced(run), "string")(source))
