"""Markdown and detection as Column expressions: no Python runs per row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from folium.text import SPACE, SPACE_CLASS

# Extensions and their MIME types; containers that share the ZIP signature.
EXTENSIONS = {
    "csv": "text/csv", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "epub": "application/epub+zip", "htm": "text/html", "html": "text/html",
    "json": "application/json", "log": "text/plain", "markdown": "text/markdown", "md": "text/markdown", "pdf": "application/pdf",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation", "txt": "text/plain", "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "xml": "application/xml",
}
ZIPPED = ("docx", "xlsx", "pptx", "epub")


def let(value: Column, make) -> Column:
    """make(value) with the value worked out once, however often it is used."""
    return F.transform(F.array(value), make)[0]


def filename(path: Column) -> Column:
    return F.substring_index(F.substring_index(path, "/", -1), "\\", -1)


def extension(path: Column) -> Column:
    name = filename(path)
    return F.when(F.instr(name, ".") > 0, F.nullif(F.lower(F.substring_index(name, ".", -1)), F.lit("")))


def mime_of_extension(ext: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    return F.element_at(table, ext)


def mimetype(content: Column, ext: Column) -> Column:
    """From the first bytes, else from the extension. content may be null."""
    head = F.coalesce(F.substring(content, 1, 8), F.lit(b""))
    starts = lambda signature: F.startswith(head, F.lit(signature))
    return (
        F.when(starts(b"%PDF"), "application/pdf")
        .when(starts(b"PK"), F.when(ext.isin(*ZIPPED), mime_of_extension(ext)).otherwise("application/zip"))
        .when(starts(b"\xd0\xcf\x11\xe0"), "application/x-ole-storage")
        .otherwise(mime_of_extension(ext))
    )


def detect(path: Column, content: Column | None = None) -> Column:
    """struct(mimetype, extension, filename)."""
    ext = extension(path)
    return F.struct(
        mimetype(F.lit(None).cast("binary") if content is None else content, ext).alias("mimetype"), ext.alias("extension"),
        filename(path).alias("filename")
    )


def decoded(content: Column) -> Column:
    return F.make_valid_utf8(content.cast("string"))


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE))


def rstrip_lines(c: Column) -> Column:
    """Without blanks and tabs at the ends of lines."""
    return F.regexp_replace(c, r"[ \t]+(?=\n|\z)", "")


def raw_block(source: Column) -> Column:
    """Text that already is Markdown: line ends made one, runs of empty lines cut to one, edges trimmed."""
    return rstrip_lines(trimmed(F.regexp_replace(F.replace(source, F.lit("\r\n"), F.lit("\n")), r"\n{3,}", "\n\n")))


def escape(value: Column, table: bool = False, line_start: bool = True) -> Column:
    any_ = r"[\\*`\[\]]|(?<![\p{L}\p{Nd}])_|_(?![\p{L}\p{Nd}])|<(?=[\p{L}/!])|&(?=[\p{L}\p{Nd}#]{1,9};)" + (r"|\|" if table else "")
    start = r"((?:\A|\n)[ \t]*" if line_start else r"(\n[ \t]*"
    passes = [
        (f"({any_})", r"\\$1"), (start + ")([#>=])", r"$1\\$2"), (start + f")([-+])(?={SPACE_CLASS}|\\z)", r"$1\\$2"),
        (start + r"\p{Nd}+)([.)])(?=[ \n]|\z)", r"$1\\$2")
    ]
    value = F.replace(F.replace(value, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return reduce(lambda c, p: F.regexp_replace(c, *p), passes, value)


def encode_url(url: Column) -> Column:
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), ((" ", "%20"), ("(", "%28"), (")", "%29")), url)


def longest_run(code: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(code, F.lit("`+"), F.lit(0)), F.length)), F.lit(0))


def code_fence(code: Column, language: Column | None = None) -> Column:
    fence = F.repeat(F.lit("`"), F.greatest(F.lit(3), longest_run(code) + 1))
    code = F.rtrim(code, F.lit("\n"))
    return F.concat(
        fence, F.lit("") if language is None else F.coalesce(language, F.lit("")), F.lit("\n"), rstrip_lines(code), F.lit("\n"), fence
    )


def code_span(code: Column) -> Column:
    tick = F.repeat(F.lit("`"), longest_run(code) + 1)
    pad = F.when(F.startswith(code, F.lit("`")) | F.endswith(code, F.lit("`")), " ").otherwise("")
    return F.concat(tick, pad, F.replace(code, F.lit("\n"), F.lit(" ")), pad, tick)


def heading(level: Column, content: Column, max_level: int = 6) -> Column:
    return F.concat(F.repeat(F.lit("#"), F.least(F.greatest(level, F.lit(1)), F.lit(max_level))), F.lit(" "), content)


def front_matter(pairs: Column, body: Column) -> Column:
    """pairs: array of struct(key, value), in the order shown."""
    head = F.array_join(
        F.transform(pairs, lambda p: F.concat(p["key"], F.lit(": "), F.replace(p["value"], F.lit("\n"), F.lit(" ")), F.lit("\n"))), ""
    )
    return F.when(F.size(pairs) > 0, F.rtrim(F.concat(F.lit("---\n"), head, F.lit("---\n\n"), body), F.lit(SPACE))).otherwise(body)


def cell(value: Column) -> Column:
    parts = F.split(escape(value, table=True, line_start=False), "\n")
    return trimmed(F.array_join(F.transform(parts, trimmed), "<br>"))


def table_row(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))


def padded(cells: Column, n: Column) -> Column:
    return F.concat(cells, F.array_repeat(F.lit(""), (n - F.size(cells)).cast("int")))


def delimiters(alignments: Column, n: Column) -> Column:
    marks = F.transform(
        alignments, lambda a: F.when(a == "LEFT", ":--").when(a == "RIGHT", "--:").when(a == "CENTER", ":-:").otherwise("---")
    )
    return F.slice(F.concat(marks, F.array_repeat(F.lit("---"), n.cast("int"))), F.lit(1), n.cast("int"))


def table(header: Column, rows: Column, alignments: Column | None = None) -> Column:
    """A Markdown table from header array<string> and rows array<array<string>>; short rows are filled, no column gives an empty string."""
    n = F.greatest(F.size(header), F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(0)))
    line = lambda cells: table_row(padded(F.transform(cells, cell), n))
    marks = delimiters(F.array().cast("array<string>") if alignments is None else alignments, n)
    out = F.array_join(F.concat(F.array(line(header), table_row(marks)), F.transform(rows, line)), "\n")
    return F.when(n > 0, out).otherwise("")


def spanned(cells: Column) -> Column:
    """array<struct(text, col_span)> to cells: each followed by the empty ones it spans."""
    return F.flatten(
        F.transform(
            cells, lambda c: F.concat(F.array(c["text"]), F.array_repeat(F.lit(""), (F.coalesce(c["col_span"], F.lit(1)) - 1).cast("int")))
        )
    )


def paragraphs(source: Column) -> Column:
    """Paragraphs of plain text with their lines kept apart."""
    joined = F.regexp_replace(source, r"\r\n|\r|\f", "\n")
    lines = lambda p: F.filter(F.transform(F.split(p, "\n"), trimmed), lambda x: x != "")
    return F.filter(F.transform(F.split(joined, r"\n[ \t]*\n"), lambda p: F.array_join(lines(p), "\n")), lambda p: p != "")


def vocabulary(source: Column) -> Column:
    """Words of two letters or more in lower case, sorted; a word comes as often as it does in the text."""
    words = lambda x: F.regexp_extract_all(x, F.lit(r"\p{L}{2,}"), F.lit(0))
    # the whole text is lowered at once, but for letters whose lower case hangs on their neighbours or is longer
    each = F.when(source.rlike("[\u0130\u03a3]"), F.transform(words(source), F.lower)).otherwise(words(F.lower(source)))
    return F.sort_array(each)


# What separates tokens of the corpus measures, the blanks they know beside ASCII's, and what Python counts as white space.
PUNCTUATION = r"""[\s!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]+"""
THIN = "\u00a0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
PY_SPACE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Line ends of the table statistics, rows, delimiter rows.
LINE_END = r"\r\n|[\n\x0b\f\r\x1c-\x1e\x85\u2028\u2029]"
TABLE_ROW = rf"^[{PY_SPACE}]*\|.*\|[{PY_SPACE}]*$"
DELIMITER_ROW = rf"^[{PY_SPACE}]*\|(?:[{PY_SPACE}]*:?-+:?[{PY_SPACE}]*\|)+[{PY_SPACE}]*$"
#: Patterns of the structure counts and of hygiene; (?md): lines end at line feeds alone.
STRUCTURE = {
    "headings": rf"(?md)^#{{1,6}} [^{PY_SPACE}]", "list_items": rf"(?md)^[{PY_SPACE}]*(?:[-*+]|\p{{Nd}}+\.) [^{PY_SPACE}]",
    "links": r"(?<!!)\[[^\]]*\]\([^)]*\)", "images": r"!\[[^\]]*\]\([^)]*\)", "code_fences": r"(?md)^```",
}
HYGIENE = {
    "blank_runs": r"\n{4,}", "trailing_ws": r"(?<![ \t])[ \t]++(?=\n|\z)", "empty_links": r"\[\]\(",
    "raw_html": r"<(?!br>)[a-zA-Z][a-zA-Z0-9]*[ >]"
}
#: What the comparing form of the tokens rewrites first; lines of chrome and tracking images go.
COMPARED = [
    ("[\u2013\u2014]", "-"), (r"(?m)^.*move to sidebar.*$", ""), (r"(?m)^\s*hide\s*$", ""), (r"(?m)^[*\s]*Toggle\b.*$", ""),
    (r"!\[[^\]]*\]\([^)]*CentralAutoLogin[^)]*\)", ""),
]
ASCII_PUNCTUATION = r"""[\s!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]+"""


def _long_tokens(source: Column, separators: str) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(source), separators), lambda t: F.length(t) > 3))


def tokens(source: Column) -> Column:
    """The set of lower-cased tokens of more than 3 characters."""
    return _long_tokens(F.translate(source, THIN, " " * len(THIN)), PUNCTUATION)


def compared_tokens(source: Column) -> Column:
    """The same after dashes, blanks and percent signs of printable ASCII are made one, and without chrome: the form that two converters' outputs are compared in."""
    coded = F.transform(F.split(source, "%(?=[0-9A-Fa-f]{2})"), lambda part, i: F.when(i == 0, part).otherwise(_decoded(part)))
    source = F.translate(F.array_join(coded, ""), THIN, " " * len(THIN))
    return _long_tokens(reduce(lambda c, p: F.regexp_replace(c, *p), COMPARED, source), ASCII_PUNCTUATION)


def _decoded(part: Column) -> Column:
    """part, from after a percent sign, with its two hexadecimal digits as their printable ASCII character, or as it was."""
    code = F.conv(F.substring(part, 1, 2), 16, 10).cast("int")
    return F.when(
        (code >= 0x20) & (code <= 0x7E), F.concat(F.chr(code), F.substring(part, 3, 2**31 - 1))
    ).otherwise(F.concat(F.lit("%"), part))


def token_similarity(reference: Column, actual: Column) -> Column:
    return F.when(F.size(reference) == 0, 1.0).otherwise(F.size(F.array_intersect(reference, actual)) / F.size(reference))


def missing_tokens(reference: Column, actual: Column) -> Column:
    return F.sort_array(F.array_except(reference, actual))


def table_stats(md: Column) -> Column:
    """struct(tables, table_rows, broken_rows): runs of lines between pipes; a row is broken if it has not as many cells as its table's first."""
    strip = lambda x, what: F.regexp_replace(x, rf"^[{what}]+|(?<![{what}])[{what}]+$", "")
    width = lambda line: F.size(F.split(strip(strip(line, PY_SPACE), "|"), r"\|"))
    rows = F.transform(
        F.split(md, LINE_END), lambda x: F.struct(F.when(x.rlike(TABLE_ROW), width(x)).alias("width"), x.rlike(DELIMITER_ROW).alias("rule"))
    )
    start = F.struct(
        *[F.lit(0).cast("long").alias(c) for c in ("tables", "table_rows", "broken_rows")], F.lit(None).cast("int").alias("columns")
    )

    def step(a: Column, row: Column) -> Column:
        inside, opens = row["width"].isNotNull() & a["columns"].isNotNull(), row["width"].isNotNull() & a["columns"].isNull()
        broken = inside & (row["width"] != a["columns"])
        return F.struct(
            (a["tables"] + opens.cast("long")).alias("tables"), (
                a["table_rows"] + (inside & ~row["rule"]).cast("long")
            ).alias("table_rows"),
            (a["broken_rows"] + F.coalesce(broken, F.lit(False)).cast("long")).alias("broken_rows"), F.when(
                row["width"].isNotNull(), F.coalesce(a["columns"], row["width"])
            ).alias("columns"),
        )

    return F.aggregate(rows, start, step, lambda a: F.struct(*[a[c].alias(c) for c in ("tables", "table_rows", "broken_rows")]))


def structure(md: Column) -> dict[str, Column]:
    """Counts of what a document has, tables included."""
    counts = {name: F.regexp_count(md, F.lit(p)).cast("long") for name, p in STRUCTURE.items()}
    counts["code_fences"] = F.floor(counts["code_fences"] / 2)
    stats = table_stats(md)
    return counts | {name: stats[name] for name in ("tables", "table_rows", "broken_rows")}


def hygiene(md: Column) -> dict[str, Column]:
    """Counts of what a converter should not leave behind."""
    return {name: F.regexp_count(md, F.lit(p)).cast("long") for name, p in HYGIENE.items()}
