"""The registered query of each operator, over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from compval.llm import bpe, chat, divergence, extraction, language_id, lexical_search, media, packing, quality, secret_scan, simhash, substring_dedup, topk_search
from compval.llm.common import read

#: The tokenizer file of the token operators.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return topk_search.top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), TOKENIZER)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.deduplicate(read(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(read(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_digests(read(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(read(spark, sf_dir, "documents"), TOKENIZER)


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(read(spark, sf_dir, "documents"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.lit("\\### Assistant: </turn> ok")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), text.alias("text"))
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digests(chat.format_turns(rows))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_classes(read(spark, sf_dir, "documents"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read(spark, sf_dir, "documents"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.rank(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(read(spark, sf_dir, "pages"))


QUERIES = {
    "op1_topk_search": op1_topk_search,
    "op2_packing": op2_packing,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_language_id": op4_language_id,
    "op5_quality": op5_quality,
    "op6_secret_scan": op6_secret_scan,
    "op7_bpe": op7_bpe,
    "op8_media": op8_media,
    "op9_chat": op9_chat,
    "op10_simhash": op10_simhash,
    "op11_divergence": op11_divergence,
    "op12_lexical_search": op12_lexical_search,
    "op13_extraction": op13_extraction,
}
#: XXH64, tokenizers, PNG, markup and learnt models have no SQL; tests/llm holds those against brute force.
ORACLE_SQL: dict[str, str] = {
    "op1_topk_search": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10""",
    "op3_substring_dedup": """WITH n AS (SELECT doc_id, encode(coalesce(text, '')) AS h, strlen(coalesce(text, '')) AS n_bytes FROM documents),
w AS (SELECT doc_id, i, CAST(doc_id AS HUGEINT) * 4294967296 + i AS p, hash(array_slice(h, i + 1, i + 100)) AS k FROM n, LATERAL (SELECT unnest(range(0, n_bytes - 99)) AS i)),
f AS (SELECT k, min(p) AS p FROM w GROUP BY k HAVING count(*) > 1), later AS (SELECT doc_id, i FROM w JOIN f ON w.k = f.k AND w.p > f.p),
runs AS (SELECT doc_id, min(i) AS s, max(i) + 100 AS e FROM (SELECT doc_id, i, sum(CASE WHEN i - p <= 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM (SELECT doc_id, i, lag(i, 1, -1000) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM later)) GROUP BY doc_id, g),
gaps AS (SELECT doc_id, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY s) AS a, s AS b FROM runs UNION ALL SELECT n.doc_id, coalesce(max(e), 0), any_value(n_bytes) FROM n LEFT JOIN runs ON runs.doc_id = n.doc_id GROUP BY n.doc_id),
kept AS (SELECT doc_id, string_agg(CASE WHEN b > a THEN hex(array_slice(h, a + 1, b)) ELSE '' END, '' ORDER BY a) AS h FROM gaps JOIN n USING (doc_id) GROUP BY doc_id),
t AS (SELECT doc_id, sum(e - s) AS removed, count(*) AS spans FROM runs GROUP BY doc_id)
SELECT n.doc_id, n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(kept.h)) AS kept_sha256 FROM n JOIN kept USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op9_chat": """WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
e AS (SELECT *, length(role) + length(text) + 14 + CASE WHEN contains(text, '\\') OR contains(text, '</turn>') OR contains(role, '\\') OR contains(role, ': ') THEN
(length(role || text) - length(replace(role || text, '\\', ''))) + (length(text) - length(replace(text, '### ', ''))) // 4 + (length(text) - length(replace(text, ': ', ''))) // 2 + (length(text) - length(replace(text, '</turn>', ''))) // 7
+ (length(role) - length(replace(role, '### ', ''))) // 4 + (length(role) - length(replace(role, ': ', ''))) // 2 + (length(role) - length(replace(role, '</turn>', ''))) // 7 ELSE 0 END AS size FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST)) AS turns_sha256,
CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST), '')) AS loss_sha256,
CAST(sum(size) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id""",
    "op11_divergence": r"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT r, lang, source, term, count(*) AS n FROM (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d) GROUP BY ALL),
kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(*) >= 30), v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
used AS (SELECT lang, source, term, CAST(sum(n) AS HUGEINT) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL), g AS (SELECT DISTINCT lang, source FROM d),
gn AS (SELECT lang, source, sum(n) AS total FROM used GROUP BY ALL), ln AS (SELECT lang, sum(n) AS total FROM used GROUP BY ALL), lc AS (SELECT lang, term, sum(n) AS n FROM used GROUP BY ALL),
p AS (SELECT g.lang, g.source, kept.term, coalesce(used.n, 0) AS n, 1 + (CAST(1000000000 AS HUGEINT) * (coalesce(used.n, 0) + 5)) // (coalesce(gn.total, 0) + 5 * v.v) AS p
FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN gn USING (lang, source) LEFT JOIN used USING (lang, source, term)),
q AS (SELECT lang, term, 1 + (CAST(1000000000 AS HUGEINT) * (lc.n + 5)) // (ln.total + 5 * v.v) AS q FROM lc JOIN ln USING (lang) JOIN v USING (lang)),
apart AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
f AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
LEFT JOIN apart ON apart.lang = a.lang AND apart.source = a.source AND apart.item = b.source
UNION ALL SELECT lang, source, 'term', term, p - q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM f)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50""",
    "op12_lexical_search": r"""WITH t AS (SELECT r, doc_id, term, count(*) AS tf FROM (SELECT row_number() OVER () AS r, doc_id,
unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents) GROUP BY ALL),
d AS (SELECT r, sum(tf) AS n FROM t GROUP BY r), s AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS l FROM d),
m AS (SELECT r, 100 - 25 + (25 * CAST(n AS BIGINT) * docs) // l AS m FROM d, s), w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM t, s GROUP BY term, docs),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
c AS (SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score FROM q JOIN t USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY ALL)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM c WHERE score > 0) WHERE rank <= 20""",
}
