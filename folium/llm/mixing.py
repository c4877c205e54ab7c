"""Mixing sources to target weights: budgets flow down a tree of domain, language and source, in native DataFrame operations.

A budget of tokens is split among the domains by weight, a domain's share among its languages, a language's among its
sources. No node gets more than it can give (its tokens times max_epochs); what it cannot give goes to its siblings, by
their weights, before anything goes back to its parent's siblings: a child's shortage only shows in its parent
once the whole family is used up. Each leaf then fills its budget from epochs: in an epoch its documents stand in an order
seeded by (seed, epoch, key), whole epochs are taken whole, and of the last one the prefix whose tokens fit.

Shares are rounded down to whole tokens at every node. Ties in the seeded order go to the
lower key, and repeated rows count as rows of their own with the order of their number.

Defined results: a null source or language is a leaf of its own (named ``unknown``); null and empty texts have no tokens and are never selected.
An empty table, or a budget of 0, gives an empty result. Nodes without a weight take the default weight 1.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folium.llm.common import stored, with_size

UNKNOWN = "unknown"


@dataclass(frozen=True)
class Weights:
    """Target weights by name at each level; a name that is absent has weight 1."""

    domain: dict[str, float] = field(default_factory=dict)
    lang: dict[str, float] = field(default_factory=dict)
    source: dict[str, float] = field(default_factory=dict)


def _weight_of(name: str, weights: dict[str, float]) -> Column:
    """The weight of the node named in a column: a literal map, as long as the weights that were given."""
    if not weights:
        return F.lit(1.0)
    table = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v))])
    return F.coalesce(F.element_at(table, F.col(name)), F.lit(1.0))


def fill(nodes: DataFrame, parent: list[str], node: str) -> DataFrame:
    """nodes with share: what each gets of its parent's budget (column budget), by weight, up to its capacity (cap); rounded down.

    Siblings stand in the order of cap / weight. As long as a sibling's capacity is no more than its part of what is left, it is filled, and the
    others divide the rest by their weights: filling one only raises the parts of those behind it."""
    open_ = nodes.where("weight > 0").withColumn("level", F.col("cap") / F.col("weight"))
    siblings = Window.partitionBy(*parent).orderBy("level", node)
    before, onward = siblings.rowsBetween(Window.unboundedPreceding, -1), siblings.rowsBetween(0, Window.unboundedFollowing)
    given = F.coalesce(F.sum("cap").over(before), F.lit(0))
    found = open_.withColumn("left", F.col("budget") - given).withColumn("open", F.sum("weight").over(onward))
    found = found.withColumn("full", F.col("cap") * F.col("open") <= F.col("left") * F.col("weight"))
    # behind the first that is not full, all divide what it divides
    first = F.min(F.when(~F.col("full"), F.struct("level", node, "left", "open"))).over(Window.partitionBy(*parent))
    found = found.withColumn("first", first)
    share = F.when(F.col("full"), F.col("cap")).otherwise(F.floor(F.col("first.left") * F.col("weight") / F.col("first.open")).cast("long"))
    return found.withColumn("share", share).drop("level", "left", "open", "full", "first")


def budgets(tokens: DataFrame, share: float, weights: Weights, max_epochs: int) -> DataFrame:
    """tokens (domain, lang, source, t, n of its leaves) with budget, of the leaves that have any. Everything is a window over the nodes of a level: nothing goes to the driver."""
    leaves = tokens.withColumn("cap", F.col("t") * max_epochs)
    langs = leaves.groupBy("domain", "lang").agg(F.sum("cap").alias("cap"), F.sum("t").alias("t"))
    domains = langs.groupBy("domain").agg(F.sum("cap").alias("cap"), F.sum("t").alias("t")).withColumn("root", F.lit(0))
    total = F.sum("t").over(Window.partitionBy("root"))
    level = domains.withColumn("budget", F.floor(total * float(share)).cast("long"))
    level = level.withColumn("weight", _weight_of("domain", weights.domain))
    level = fill(level, ["root"], "domain").select("domain", F.col("share").alias("budget"))
    level = fill(
        langs.join(level, "domain").withColumn("weight", _weight_of("lang", weights.lang)), ["domain"], "lang"
    ).select("domain", "lang", F.col("share").alias("budget"))
    level = fill(
        leaves.join(level, ["domain", "lang"]).withColumn("weight", _weight_of("source", weights.source)), ["domain", "lang"], "source"
    )
    return level.where("share > 0").select("domain", "lang", "source", "t", "n", F.col("share").alias("budget"))


def token_count(text: Column) -> Column:
    """Runs of what isn't ASCII white space: the tokens that budgets count by default."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+")), F.lit(0)).cast("long")


def select_mix(
    docs: DataFrame, domain: Column, weights: Weights, share: float = 0.5, max_epochs: int = 2, seed: int = 17, key: str = "doc_id",
    text: str = "text", lang: str = "lang", source: str = "source", tokens: Column | None = None
) -> DataFrame:
    """key, domain, lang, source, tokens, copies (in how many epochs it is taken) of the selected documents.

    The budget is share x all tokens."""
    leaf = ["domain", "lang", "source"]
    named = lambda c: F.coalesce(c, F.lit(UNKNOWN))
    rows = docs.select(
        F.col(key).alias("key"), named(domain).alias("domain"), named(F.col(lang)).alias("lang"), named(F.col(source)).alias("source"),
        (token_count(F.col(text)) if tokens is None else tokens).alias("tokens")
    )
    rows = stored(rows.where("tokens > 0"), "mix")
    leaves = stored(rows.groupBy(*leaf).agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n")), "leaves")
    given = budgets(leaves, share, weights, max_epochs)
    # a leaf's last epoch is cut into about as many ranges of the seeded order as a range has documents: neither grows beyond the root of a leaf
    plan = given.select(
        *leaf, F.expr("budget div t").alias("epochs"), (F.col("budget") % F.col("t")).alias("rest"),
        F.greatest(F.lit(1), F.floor(F.sqrt("n"))).cast("long").alias("ranges")
    )
    marked = rows.join(with_size(stored(plan, "plan")), leaf)
    order = F.pmod(F.xxhash64(F.lit(seed), "epochs", "key"), F.lit(1 << 40))
    marked = marked.withColumn("order", order).withColumn("range", F.floor(F.col("order") * F.col("ranges") / float(1 << 40)).cast("long"))
    last = marked.where("rest > 0")
    ranges = last.groupBy(*leaf, "range").agg(F.sum("tokens").alias("t"))
    before = ranges.select(*leaf, "range", (F.sum("t").over(Window.partitionBy(*leaf).orderBy("range")) - F.col("t")).alias("before"))
    inside = F.sum("tokens").over(
        Window.partitionBy(*leaf, "range").orderBy("order", "key", "tokens").rowsBetween(Window.unboundedPreceding, 0)
    )
    kept = last.withColumn("inside", inside).join(before, [*leaf, "range"]).withColumn(
        "more", (F.col("before") + F.col("inside") <= F.col("rest")).cast("long")
    )
    whole = marked.where("rest = 0").withColumn("more", F.lit(0).cast("long"))
    both = kept.select("key", *leaf, "tokens", "epochs", "more").unionByName(whole.select("key", *leaf, "tokens", "epochs", "more"))
    return both.withColumn("copies", F.col("epochs") + F.col("more")).where("copies > 0").select(
        F.col("key").alias(key), *leaf, "tokens", "copies"
    )
