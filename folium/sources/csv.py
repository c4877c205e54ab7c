"""CSV files of any size, each byte range read once.

Quotes open and close anywhere, so whether a line begins inside quotes hangs on all quotes before it. A task reads its ranges line by line and notes how many quotes each line has behind the range's start: its lines are
known for either state that the range may begin in. The ranges' own parities, a row each, are added up in order; then every line knows its state. A line that begins and ends
outside of quotes is whole; others are joined to records by the line that opened them, and only they are shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folium.functions import columns as C
from folium.operators.stage import small, written

LINES = "path string, block long, line long, value string, before int, quotes int, even long, odd long"
#: Fixed value: what is trimmed from fields.
BLANK = " \t\n\r"
# a quote that never closes reaches to the end
_RECORD = r'((?:[^"\r]++|"[^"]*+(?:"|\z))*+)(?:\r|\z)'
_FIELD, _OPEN = r'((?:[^",]++|"[^"]*+")*+),', r'((?:[^",]++|"[^"]*+(?:"|\z))*+)(?:,|\z)'


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """LINES: before is the parity of the quotes between the range's start and the line, quotes that of the line's own; even and odd are the last lines up to it that have such a parity before them, -1 for none."""
    read = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))

    def run(batches):
        of, line, parity, last = None, 0, 0, [-1, -1]
        for batch in batches:
            if not batch.num_rows:
                continue
            paths, blocks = batch.column("path"), batch.column("block").to_numpy()
            named = paths.dictionary_encode()
            # ranges follow each other; one ends where the next begins
            cuts = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(named.indices.to_numpy()) != 0)) + 1
            for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                part = batch.slice(start, end - start)
                here = (paths[start].as_py(), int(blocks[start]))
                if here != of:
                    of, line, parity, last = here, 0, 0, [-1, -1]
                own = pc.count_substring(part.column("value"), '"').to_numpy(zero_copy_only=False).astype(np.int64) & 1
                after = (parity + np.cumsum(own)) & 1
                before = np.concatenate([[parity], after[:-1]])
                number = np.arange(line, line + len(own))
                opened = [np.maximum.accumulate(np.where(before == k, number, last[k])) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("path"), part.column("block"), pa.array(number), part.column("value"), pa.array(before.astype(np.int32)), pa.array(own.astype(np.int32)),
                        *map(pa.array, opened)
                    ], names=["path", "block", "line", "value", "before", "quotes", "even", "odd"]
                )
                line, parity, last = line + len(own), int(after[-1]), [int(x[-1]) for x in opened]

    return read.mapInArrow(run, LINES)


def _fields(record: Column) -> Column:
    def field(raw: Column) -> Column:
        raw = F.btrim(raw, F.lit(BLANK))
        bare = F.regexp_replace(F.regexp_replace(raw, r'\A"', ""), r'"\z', "")
        return F.when(F.contains(raw, F.lit('"')), F.replace(bare, F.lit('""'), F.lit('"'))).otherwise(raw)

    # the last field of an open record ends with the text, where the pattern meets once more
    open_ = F.slice(F.regexp_extract_all(record, F.lit(_OPEN), F.lit(1)), F.lit(1), F.size(F.regexp_extract_all(record, F.lit(_OPEN), F.lit(1))) - 1)
    quotes = F.length(record) - F.length(F.replace(record, F.lit('"'), F.lit("")))
    found = F.when(quotes % 2 == 1, open_).otherwise(F.regexp_extract_all(F.concat(record, F.lit(",")), F.lit(_FIELD), F.lit(1)))
    return F.transform(found, field)


def _records(text: Column) -> Column:
    """Records of text that begins outside of quotes."""
    found = F.regexp_extract_all(text, F.lit(_RECORD), F.lit(1))
    return F.filter(found, lambda r: F.btrim(r, F.lit(BLANK)) != "")


def read_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, block, line, part (where a record begins: the range's start, the line in it, the record in the line) and cells of every record.

    Records keep their own lengths, empty lines are none, and cells are trimmed before their quotes go. A byte order mark goes with the reader. An empty file has no record."""
    lines = written(_lines(spark, path), "csv-lines")
    ranges = lines.groupBy("path", "block").agg((F.sum("quotes") % 2).alias("quotes"))
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    state = ranges.select("path", "block", (F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2).alias("state"))
    known = lines.join(small(state, "csv-states"), ["path", "block"]).withColumn("inside", (F.col("before") + F.col("state")) % 2 == 1)
    ends_inside = F.col("inside") != (F.col("quotes") == 1)
    alone = known.where(~F.col("inside") & ~ends_inside).select("path", "block", "line", F.col("value").alias("text"))
    split = known.where(F.col("inside") | ends_inside)
    # the line that opened the record: the last in the range, else the last of the ranges before
    here = F.when(F.col("state") == 0, F.col("even")).otherwise(F.col("odd"))
    split = split.withColumn("here", F.when(here >= 0, F.struct("block", here.alias("line"))))
    last = split.groupBy("path", "block").agg(F.max("here").alias("opened"))
    carried = last.select("path", "block", F.last("opened", ignorenulls=True).over(earlier).alias("carried"))
    owned = split.join(small(carried, "csv-carried"), ["path", "block"]).withColumn("owner", F.coalesce("here", "carried"))
    joined = owned.groupBy("path", "owner").agg(F.sort_array(F.collect_list(F.struct("block", "line", "value"))).alias("parts")).select(
        "path", "owner.block", "owner.line", F.array_join(F.transform("parts", lambda p: p["value"]), "\n").alias("text")
    )
    found = alone.unionByName(joined).select("path", "block", "line", F.posexplode(_records(C.decoded(F.col("text")))).alias("part", "record"))
    return found.select("path", "block", "line", "part", _fields(F.col("record")).alias("cells"))
