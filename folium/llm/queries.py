"""The training-data queries over the standard tables, with production parameters; each takes (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.llm import decontaminate, divergence, language_id, line_dedup, minhash, mixing, packing, pii, quality, search, url_filter, warc, whitening
from folium.llm.common import table

#: The key of the pseudonyms; a deployment passes its own.
PSEUDONYM_KEY = b"folium-demonstration-key"
VOCABULARY = "byte_bpe_50k.json"
CAPACITY, END_ID = 1024, 2
URL_RULES = [
    url_filter.Rule("block", "com", "/en/"),
    url_filter.Rule("allow", "example.com", "/en/7"),
    url_filter.Rule("allow", "net", "/de/"),
    url_filter.Rule("block", "example.net", "/de/8"),
    url_filter.Rule("block", "org", "/es/"),
]
#: Tokens to select: as many as the documents have, each of them at most twice.
MIX_SHARE, MAX_EPOCHS = 1.0, 2
MIX = mixing.Weights(domain={"web": 5, "reference": 3, "forum": 2}, lang={"en": 4, "de": 2, "fr": 2, "es": 2})


def domain_of(source: Column) -> Column:
    """The domain tree over sources: every third source is reference, the next forum, the others web."""
    number = F.regexp_extract(source, "([0-9]+)$", 1).try_cast("long")
    return F.when(number % 3 == 1, "reference").when(number % 3 == 2, "forum").otherwise("web")


def vocabulary() -> str:
    return public_tokenizers.path(VOCABULARY)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), equal_chars=1)
    return found.select(
        "doc_id", "n_lines", "dropped_equal", "dropped_near", F.length("text").cast("long").alias("kept_chars"),
        F.crc32(F.col("text").cast("binary")).alias("kept_crc32")
    )


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(table(spark, sf_dir, "documents"), PSEUDONYM_KEY)


def op3_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(table(spark, sf_dir, "documents"), F.col("doc_id") % 100 == 0)


def mixed(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    return mixing.select_mix(docs, domain_of(F.col("source")), MIX, share=MIX_SHARE, max_epochs=MAX_EPOCHS, key=key)


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"))


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary(), CAPACITY, END_ID)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.filter_quality(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge(pages, URL_RULES, url_filter.fit(pages, URL_RULES))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.derivatives(table(spark, sf_dir, "pages"))
    return found.withColumnRenamed("key", "page_id").withColumn("record_crc32", F.crc32("record")).drop("record")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trained = language_id.fit(docs.where(~language_id.held_out(F.col("doc_id"))))
    found = language_id.predict(docs, trained, keep=["doc_id"])
    return found.select(
        "doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected"
    )


def op11_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_line_dedup, op2_pii, op3_search, op4_mix, op5_pack, op6_quality, op7_url_filter, op8_warc, op9_near_dedup, op10_language, op11_decontaminate,
        op12_divergence, op13_whitening
    )
}
_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_OP11 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({_LOWER.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
ip AS (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM i WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS g FROM ip),
lengths AS (SELECT DISTINCT n FROM iw),
dp AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, lengths WHERE len(w) >= n),
m AS (SELECT r, p, n, item_id FROM (SELECT r, p, n, array_to_string(w[p:p + n - 1], ' ') AS g FROM dp) JOIN iw USING (n, g)),
h AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT DISTINCT r, unnest(range(p, p + n)) AS q FROM m) GROUP BY r),
s AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM m GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN s USING (r)"""
_OP12 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, text FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all({_LOWER.format("text")}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM d),
kept AS (SELECT lang, t FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 3),
c AS (SELECT lang, source, t, count(*) AS n FROM w JOIN kept USING (lang, t) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
dense AS (SELECT g.lang, g.source, kept.t, coalesce(n, 0) AS n FROM g JOIN kept USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.t = kept.t),
p AS (SELECT lang, source, t, n, CAST(1 + (1000000000 * (CAST(n AS HUGEINT) + 1)) // sum(n + 1) OVER (PARTITION BY lang, source) AS BIGINT) AS p FROM dense),
whole AS (SELECT lang, t, sum(n) AS n FROM dense GROUP BY ALL),
q AS (SELECT lang, t, CAST(1 + (1000000000 * (CAST(n AS HUGEINT) + 1)) // sum(n + 1) OVER (PARTITION BY lang) AS BIGINT) AS q FROM whole),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY ALL),
scored AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source
 UNION ALL SELECT lang, source, 'term', t, CAST((p - q) * (p - q) // q AS BIGINT) FROM p JOIN q USING (lang, t) WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM scored)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200"""
#: The others can't be expressed in SQL: they are tested against brute force, round trips and held-out rows in tests/llm.
ORACLES: dict[str, str] = {"op11_decontaminate": _OP11, "op12_divergence": _OP12}
