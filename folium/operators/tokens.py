"""JSON laid out from its tokens as rows: a running depth over a window instead of a parser, in Catalyst alone."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folium.operators.stage import written
from folium.text import SPACE

#: Stands before each escape, so that a pattern sees from the quote alone whether it closes a string.
_MARK = "\uffff"
_BLANK = re.escape(SPACE)
#: A string, a structural character, or what stands between them; no alternative is a group, so matching takes no stack.
_TOKEN = rf'"[\s\S]*?(?<!{_MARK}\\)"|[{{}}\[\],:]|[^{_BLANK}{{}}\[\],:]++'


def pretty_json(df: DataFrame, key: str, text: str) -> DataFrame:
    """key and text of every row, re-indented by 4 with its tokens as they were written.

    Text that breaks off within a string, after a comma or before any value comes back as it is; null is read as empty. Rows are numbered and written first, so
    keys may be of any type, null or repeated. Tokens are dealt by row in one exchange; within it a window knows the neighbours and the depth of each."""
    given = df.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("text"))
    rows = written(given, "json")
    marked = F.regexp_replace("text", rf"(?s)(\\.|{_MARK})", f"{_MARK}$1")
    found = rows.select("row", F.posexplode(F.regexp_extract_all(marked, F.lit(_TOKEN), F.lit(0))).alias("at", "token"))
    order = Window.partitionBy("row").orderBy("at")
    near = lambda c, kinds: F.coalesce(c.isin(*kinds), F.lit(False))
    token, following = F.col("token"), F.lead("token").over(order)
    opens, closes = token.isin("{", "["), token.isin("}", "]")
    found = found.select(
        "row", "at", "token", following.alias("following"), (opens & near(following, "}]")).alias("empty"),
        (closes & near(F.lag("token").over(order), "{[")).alias("done")
    )
    step = F.when(opens & ~F.col("empty"), 1).when(closes & ~F.col("done"), -1).otherwise(0)
    line = F.concat(F.lit("\n"), F.repeat(F.lit("    "), F.sum(step).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int")))
    piece = F.when(F.col("done"), "").when(F.col("empty"), F.concat(token, "following")).when(opens | (token == ","), F.concat(token, line)).when(
        closes, F.concat(line, token)
    ).when(token == ":", ": ").otherwise(token)
    torn = F.startswith(token, F.lit('"')) & ~((F.length(token) > 1) & F.endswith(token, F.lit('"')) & ~F.endswith(token, F.lit(f'{_MARK}\\"')))
    says = (token != ":") & (~opens | F.col("empty"))  # whether the text may end here
    found = found.select("row", "at", piece.alias("piece"), torn.alias("torn"), F.when(says, token != ",").alias("whole"))
    laid = found.groupBy("row").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "piece"))), lambda p: p["piece"]), "").alias("laid"),
        F.bool_or("torn").alias("torn"), F.max_by("whole", F.when(F.col("whole").isNotNull(), F.col("at"))).alias("whole")
    )
    whole = F.coalesce(F.col("whole") & ~F.col("torn"), F.lit(False))
    out = F.when(whole, F.regexp_replace("laid", rf"{_MARK}([\\{_MARK}])", "$1")).otherwise(F.col("text"))
    return rows.join(laid, "row", "left").select(F.col("key").alias(key), out.alias(text))
