"""The registered queries of this subpackage: thin applications of its operators to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ocellus.llm import bloom_lm, content_sort, licenses, minhash, mixing, ngram_join, packing, quality, secrets, suffixes


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return ngram_join.ngram_links(docs, width=3, num=90, den=100)


def op2_license_scan(spark, sf_dir):
    return licenses.license_scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def held_out(doc_id):
    """Rows whose labels are never learned from: crc32 of the id as text, mod 3, is 1."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def op3_quality(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, _table(spark, sf_dir, "labels"), lambda i: ~held_out(i))
    return quality.score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_secret_scan(spark, sf_dir):
    found = secrets.scan_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"),
        F.sha2(secrets.span_digest("spans", True), 256).alias("base_sha256"),
        secrets.span_digest(F.col("spans"), False).alias("spans"),
    )


def op5_mix_sources(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mixed(docs).select("doc_id", "size", "source_size", "target", "taken")


def op6_lm_scores(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2
    return bloom_lm.score_texts(docs, ~held_out).withColumn("held_out", held_out)


def op7_exact_dedup(spark, sf_dir):
    return content_sort.exact_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"), keep="largest")


def op8_fingerprints(spark, sf_dir):
    return minhash.edited_fingerprints(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_pack(spark, sf_dir):
    import public_tokenizers

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_suffix_dedup(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffixes.remove_repeats(docs).drop("kept")


QUERIES = {f.__name__: f for f in (op1_ngram_join, op2_license_scan, op3_quality, op4_secret_scan, op5_mix_sources, op6_lm_scores, op7_exact_dedup, op8_fingerprints, op9_pack, op10_suffix_dedup)}
ORACLES: dict[str, str] = {
    "op1_ngram_join": r"""
        WITH RECURSIVE w AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
                ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END)) AS grams FROM w),
        c AS (SELECT doc_id, len(grams) AS n, CASE WHEN len(grams) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY grams) END AS class_id FROM s),
        g AS (SELECT doc_id, n, unnest(grams) AS gram FROM s JOIN c USING (doc_id) WHERE c.class_id = doc_id),
        l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
              GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r AS (SELECT class_id AS id, class_id AS reached FROM c WHERE class_id = doc_id UNION SELECT r.id, e.b FROM r JOIN e ON r.reached = e.a),
        m AS (SELECT id, min(reached) AS component_id FROM r GROUP BY id)
        SELECT c.doc_id, CAST(c.n AS BIGINT) AS n_shingles, m.component_id, c.class_id FROM c JOIN m ON c.class_id = m.id""",
    "op2_license_scan": licenses.scan_sql(licenses.KNOWN),
    "op7_exact_dedup": """
        WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
             g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
        SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
        FROM t JOIN g USING (norm)""",
}
