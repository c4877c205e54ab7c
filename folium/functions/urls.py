"""URL references resolved against a base, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folium.functions import columns as C

#: Schemes of bases that references are resolved against; a scheme.
SCHEMES = ("http", "https", "file", "ftp")
_SCHEME = r"\A([A-Za-z][A-Za-z0-9+.\-]*):"
def _parts(reference: Column) -> Column:
    """struct(authority, path, query, fragment) of a reference without its scheme; what is missing is empty."""
    without = lambda x, mark: F.substring_index(x, mark, 1)
    behind = lambda x, head: F.substring(x, F.length(head) + 2, F.length(x))

    def split(at: Column) -> Column:
        whole, rest = at["whole"], at["rest"]
        path = without(rest, "?")
        named = F.startswith(path, F.lit("//"))
        authority = F.when(named, without(F.substring(path, 3, 1 << 30), "/")).otherwise("")
        return F.struct(
            authority.alias("authority"), F.when(named, F.substring(path, F.length(authority) + 3, F.length(path))).otherwise(path).alias("path"), behind(rest, path).alias("query"),
            behind(whole, rest).alias("fragment")
        )

    return C.let(F.struct(reference.alias("whole"), without(reference, "#").alias("rest")), split)


def without_dots(path: Column, joined: Column) -> Column:
    """A path without . and .. segments, which go up as far as there is a way; one that was joined also without empty segments within it."""
    parts = F.split(path, "/")
    inner = F.when(joined, F.filter(parts, lambda p, i: (p != "") | (i == 0) | (i == F.size(parts) - 1))).otherwise(parts)
    # a dot at the end leaves a folder
    ended = F.when(F.element_at(inner, -1).isin(".", ".."), F.concat(inner, F.array(F.lit("")))).otherwise(inner)
    step = lambda a, p: F.when(p == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).when(p == ".", a).otherwise(F.concat(a, F.array(p)))
    return F.coalesce(F.nullif(F.array_join(F.aggregate(ended, F.array().cast("array<string>"), step), "/"), F.lit("")), F.lit("/"))


def _merged(base_path: Column, path: Column) -> Column:
    """A path on that of the base."""
    rooted = F.startswith(path, F.lit("/"))

    def clean(merged: Column) -> Column:
        plain = ~(F.contains(merged, F.lit("/.")) | F.contains(merged, F.lit("//")) | F.startswith(merged, F.lit(".")))
        return F.when(plain, merged).otherwise(without_dots(merged, ~rooted))

    folder = F.substring(base_path, F.lit(1), F.length(base_path) - F.length(F.substring_index(base_path, "/", -1)))
    return C.let(F.when(rooted, path).otherwise(F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), path)), clean)


def resolved(base: Column, reference: Column) -> Column:
    """The reference as a URL: itself where it has a scheme of its own, or where the base is none of SCHEMES or null; null for null.

    White space at the edges goes. Empty queries and fragments aren't kept, and the base's fragment never."""
    tail = lambda mark, x: F.when(x == "", "").otherwise(F.concat(F.lit(mark), x))

    def joined(s: Column) -> Column:
        rest, root = s["rest"], s["root"]
        path, named = rest["path"], rest["authority"] != ""  # an empty authority is none
        new_path = F.when(named, path).when(path == "", root["path"]).otherwise(_merged(root["path"], path))
        new_query = F.when((path == "") & ~named & (rest["query"] == ""), root["query"]).otherwise(rest["query"])
        host = F.when(named, rest["authority"]).otherwise(root["authority"])

        def put(new_path: Column) -> Column:
            slash = F.when((new_path != "") & ~F.startswith(new_path, F.lit("/")), "/").otherwise("")
            return F.concat(s["scheme"], F.lit("://"), host, slash, new_path, tail("?", new_query), tail("#", rest["fragment"]))

        return C.let(new_path, put)

    def made(s: Column) -> Column:
        ref, scheme, own = s["ref"], s["scheme"], s["own"]
        usable = F.coalesce(scheme.isin(*SCHEMES) & F.contains(s["base"], F.lit("://")), F.lit(False))
        rest = F.when(own == scheme, F.substring(ref, F.length(own) + 2, F.length(ref))).otherwise(ref)
        root = F.substring(F.translate(s["base"], "\t\r\n", ""), F.length(scheme) + 2, F.length(s["base"]))
        parts = F.struct(scheme.alias("scheme"), _parts(rest).alias("rest"), _parts(root).alias("root"))
        return F.when(~usable, s["reference"]).when((own != "") & (own != scheme), C.trimmed(s["reference"])).when(
            ref == "", s["base"]
        ).otherwise(C.let(parts, joined))

    ref = F.translate(C.trimmed(reference), "\t\r\n", "")
    given = F.struct(
        base.alias("base"), reference.alias("reference"), ref.alias("ref"), F.lower(F.regexp_extract(base, _SCHEME, 1)).alias("scheme"),
        F.lower(F.regexp_extract(ref, _SCHEME, 1)).alias("own")
    )
    return C.let(given, made)
