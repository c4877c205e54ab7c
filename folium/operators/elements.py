"""HTML elements as a table, and rules of the walk as windows over it.

Every element has its number in document order (element_id) and that of its last descendant (last_id): what it holds is a range. One shuffle by document serves all windows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folium.parsers.html_tree import Element, parse
from folium.parsers.html_walk import DROPPED

ELEMENT = "array<struct<element_id:int,parent_id:int,last_id:int,depth:int,tag:string>>"


def _elements(source: str, out: list[list]) -> None:
    """Puts the elements below the root, in document order, behind those that the columns of out hold."""
    parents, lasts, depths, tags = out
    base = len(tags)
    stack: list = [(c, -1, 0) for c in reversed(parse(source).root.children) if isinstance(c, Element)]
    while stack:
        e, at, depth = stack.pop()
        if e is None:  # at is its own number now
            lasts[base + at] = len(tags) - base - 1
            continue
        me = len(tags) - base
        parents.append(at)
        lasts.append(me)
        depths.append(depth)
        tags.append(e.tag)
        below = [(c, me, depth + 1) for c in reversed(e.children) if isinstance(c, Element) and c.tag != "#comment"]
        if below:
            stack.append((None, me, depth))
            stack += below


def element_table(df: DataFrame, key: str, html: str = "html") -> DataFrame:
    """key, element_id, parent_id, last_id, depth, tag: a row for each element; a null text has none."""

    def run(sources: pa.Array) -> pa.Array:
        out: list[list] = [[], [], [], []]
        ends = [0]
        for i in range(len(sources)):  # one by one, so that a batch's texts are never Python objects at once
            if (source := sources[i].as_py()) is not None:
                _elements(source, out)
            ends.append(len(out[-1]))
        ids = np.arange(ends[-1]) - np.repeat(ends[:-1], np.diff(ends))
        values = [pa.array(v, pa.int32()) for v in (ids, *out[:3])] + [pa.array(out[3], pa.string())]
        names = ("element_id", "parent_id", "last_id", "depth", "tag")
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(values, list(names)))

    return df.select(key, F.explode(F.arrow_udf(run, ELEMENT)(F.col(html))).alias("e")).select(key, "e.*")


def marked(elements: DataFrame, key: str) -> DataFrame:
    """elements with dropped (it or what holds it never counts) and table_id (the nearest table above it, null outside of any)."""
    # a table opens one level with its first descendant and closes it behind its last: the nearest one is the last that opened the level an element is on
    is_table = F.col("tag") == "table"
    both = F.when(is_table, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    rows = elements.withColumn("closes", F.explode(both))
    at = F.when(F.col("closes"), F.col("last_id") + 1).otherwise(F.col("element_id")).cast("long")
    rows = rows.withColumn("place", at * 2 + (~F.col("closes")).cast("int"))
    in_order = Window.partitionBy(key).orderBy("place")
    # ranges never cross: an element is within a dropped one if any that began before reaches it
    reach = F.max(F.when(F.col("tag").isin(*DROPPED), F.col("last_id"))).over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    level = F.sum(F.when(F.col("closes"), -1).otherwise(is_table.cast("int"))).over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumns({"dropped": F.coalesce(reach >= F.col("element_id"), F.lit(False)), "level": F.coalesce(level, F.lit(0))}).where(~F.col("closes"))
    # its own level for an element, the level that it opens for a table
    own = rows.withColumn("opens", F.explode(both)).withColumn("level", F.col("level") + F.col("opens").cast("int"))
    of_level = Window.partitionBy(key, "level").orderBy("element_id").rowsBetween(Window.unboundedPreceding, -1)
    nearest = F.when(F.col("level") > 0, F.last(F.when(F.col("opens"), F.col("element_id")), ignorenulls=True).over(of_level))
    return own.withColumn("table_id", nearest).where(~F.col("opens")).drop("closes", "place", "level", "opens")


def table_counts(elements: DataFrame, key: str) -> DataFrame:
    """key, table_id, rows, body_rows, has_header, dropped: sums of each table's own rows; dropped elements stand under the null table_id, which every key with any has."""
    counts, is_row = ~F.col("dropped"), F.col("tag") == "tr"
    sum_of = lambda of: F.sum((counts & of).cast("int"))
    # a row asks its children, so both are brought under the row's number
    cells = marked(elements, key).groupBy(key, F.when(is_row, F.col("element_id")).otherwise(F.col("parent_id")).alias("row_id")).agg(
        F.max(F.when(counts & is_row, F.col("table_id"))).alias("table_id"), sum_of(F.col("tag").isin("td", "th")).alias("cells"),
        sum_of(~F.col("tag").isin("th", "tr")).alias("others"), F.sum(F.col("dropped").cast("long")).alias("dropped")
    )
    # only the very first row can be the header: the least number of all has, as its last digit, whether that row is one
    header = ((F.col("others") == 0) & (F.col("cells") > 0)).cast("int")
    first = F.min(F.col("row_id").cast("long") * 2 + header)
    rows = cells.groupBy(key, "table_id").agg(F.sum((F.col("cells") > 0).cast("long")).alias("rows"), (first % 2 == 1).alias("has_header"), F.sum("dropped").alias("dropped"))
    return rows.withColumn("body_rows", F.col("rows") - F.col("has_header").cast("int"))


def _has_rows() -> Column:
    return F.col("table_id").isNotNull() & (F.col("rows") > 0)


def table_rows(elements: DataFrame, key: str) -> DataFrame:
    """key, table_id, body_rows, has_header of the tables that have cells: rows are the tr below a table without another one between; one without cells is none, and only the very first can be the header."""
    return table_counts(elements, key).where(_has_rows()).select(key, "table_id", "body_rows", "has_header")


def document_tables(elements: DataFrame, key: str) -> DataFrame:
    """key, tables, body_rows, headers, dropped (elements) of each document that has a table with cells, in one pass over its elements."""
    sums = table_counts(elements, key).groupBy(key).agg(
        F.sum(_has_rows().cast("long")).alias("tables"), F.sum(F.when(_has_rows(), F.col("body_rows"))).alias("body_rows"),
        F.sum(F.when(_has_rows(), F.col("has_header").cast("long"))).alias("headers"), F.sum("dropped").alias("dropped")
    )
    return sums.where("tables > 0")
