"""The queries of this subpackage: thin digests of its operators over whole tables, and
their SQL where SQL can express them in the time there is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinscope.llm import embedding_dedup, language_id, packing, quality_rules, simhash, source_mixing, substring_dedup, suffix_dedup, toxicity, warc
from twinscope.llm.shared import new_path, table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality_rules.judge(docs, table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *quality_rules.COUNTS, "base_failed", "kept", "rule")


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = source_mixing.assign(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda total, c: total + c["words"])
    digest = mixed.select("doc_id", "size", "source_size", "target", taken.alias("taken"), F.size("copies").alias("n_copies"), F.get("copies", F.lit(0))["position"].alias("first_position"))
    return digest.orderBy("first_position", "doc_id")


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, x: total + x["end"] - x["start"])
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = simhash.cluster(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return grouped.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, x: total + x["end"] - x["start"])
    return cut.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"), F.size("spans").alias("n_spans"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "archive")
    warc.write(table(spark, sf_dir, "pages"), path)
    records = warc.read(spark, path)
    page = lambda c: F.regexp_extract(c, warc.URN + r"(-?\d+)>", 1).try_cast("long")
    return records.select(
        page(F.col("id")).alias("page_id"),
        "payload_bytes",
        F.coalesce(F.sha2("payload", 256), F.regexp_replace("digest", "^sha256:", "")).alias("payload_digest"),
        "record_type",
        page(F.col("refers_to")).alias("refers_to"),
    )


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", language_id.held_out(F.col("doc_id"), 5, 0).alias("held_out"))
    model = toxicity.fit(docs.where(~F.col("held_out")), table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, keep=("doc_id", "held_out"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", language_id.held_out(F.col("doc_id"), 3, 1).alias("held_out"))
    model = language_id.fit(docs.where(~F.col("held_out")))
    return language_id.predict(docs.drop("lang"), model, keep=("doc_id", "held_out"))


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_source_mixing, op3_embedding_dedup, op4_suffix_dedup, op5_packing, op6_simhash, op7_substring_dedup, op8_warc, op9_toxicity, op10_language_id)}

_WORDS = "SELECT doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents"
ORACLE: dict[str, str] = {
    "op3_embedding_dedup": """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
 l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.9), r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
 SELECT a AS vec_id, (SELECT count(*) FROM l WHERE l.a = r.a) AS n_links, min(b) AS component_id, min(b) = a AS kept FROM r GROUP BY a""",
    "op7_substring_dedup": f"""WITH d AS ({_WORDS}), t AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)), f AS (SELECT s, min(doc_id) AS m FROM t GROUP BY 1),
 c AS (SELECT DISTINCT doc_id, i + k AS p FROM t JOIN f USING (s), range(13) AS x(k) WHERE f.m < doc_id), e AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
 k AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.p) AS kept FROM e LEFT JOIN c ON c.doc_id = e.doc_id AND c.p = e.p WHERE c.p IS NULL GROUP BY 1), n AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (WHERE q IS DISTINCT FROM p - 1) AS n_spans FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS q FROM c) GROUP BY 1)
 SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256, CAST(coalesce(n_spans, 0) AS INTEGER) AS n_spans FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id""",
    "op8_warc": """WITH p AS (SELECT page_id, coalesce(html, '') AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS m FROM pages), q AS (SELECT *, octet_length(encode(h)) AS n, octet_length(encode(h)) >= 100 AND m <> page_id AS again FROM p)
 SELECT page_id, n AS payload_bytes, sha256(h) AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN m END AS refers_to FROM q""",
}
