"""Slides, detections, tumours, tissue and logs as views over the benchmark tables.

The statements are plain integer SQL that Spark and DuckDB read alike; tables and
other adapters are named in braces.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

ADAPTERS = {
    "slides": """
        SELECT s_suppkey AS slide_id, s_name AS image_name, CAST(2000 AS BIGINT) AS width, CAST(2000 AS BIGINT) AS height,
               CASE WHEN s_nationkey % 2 = 0 THEN CAST(0.25 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END AS mpp
        FROM {supplier}""",
    "detections": """
        SELECT det_id, slide_id, x1, y1, x1 + w AS x2, y1 + h AS y2, w * h AS area_px, score
        FROM (SELECT l_orderkey * 8 + l_linenumber AS det_id, l_suppkey AS slide_id,
                     (l_orderkey * 7919 + l_linenumber * 104729) % 1900 AS x1,
                     (l_partkey * 6271 + l_orderkey * 31) % 1900 AS y1,
                     20 + CAST(l_quantity AS BIGINT) AS w, 20 + l_partkey % 40 AS h,
                     CAST(1.0 AS DOUBLE) - l_discount AS score,
                     row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                                        ORDER BY l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS rn
              FROM {lineitem}) q
        WHERE rn = 1""",
    "tumors": """
        SELECT p_partkey AS tumor_key, p_partkey % ns AS slide_id,
               (p_partkey * 977) % 1800 AS x1, (p_partkey * 1409) % 1800 AS y1,
               (p_partkey * 977) % 1800 + 40 + p_size AS x2, (p_partkey * 1409) % 1800 + 40 + p_size AS y2,
               p_retailprice AS score
        FROM {part} CROSS JOIN (SELECT count(*) AS ns FROM {supplier}) n""",
    "tissue": """
        SELECT c_custkey AS tissue_id, c_custkey % ns AS slide_id,
               (c_custkey * 613) % 1500 AS x1, (c_custkey * 331) % 1500 AS y1,
               (c_custkey * 613) % 1500 + 200 AS x2, (c_custkey * 331) % 1500 + 200 AS y2,
               CAST((c_custkey * 37) % 100 AS DOUBLE) / 100.0 AS score
        FROM {customer} CROSS JOIN (SELECT count(*) AS ns FROM {supplier}) n""",
    "batch_log": """
        SELECT o_orderkey AS seq, o_custkey AS image_id,
               CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending'
                    ELSE CASE WHEN o_orderpriority LIKE '1%' THEN 'failed' ELSE 'processing' END END AS status,
               CAST(floor(o_totalprice) AS BIGINT) % 3600 AS seconds,
               CASE WHEN o_orderpriority LIKE '1%' THEN 'failed: cannot allocate' ELSE '' END AS error_message
        FROM {orders}""",
    "oom_log": """
        SELECT event_id, ts, user_id AS pid, event_type AS image_file, value AS memory_pct
        FROM {events} WHERE event_type = 'error'""",
    "window_detections": """
        SELECT d.det_id, d.slide_id, w.x AS win_x, w.y AS win_y, d.score,
               greatest(d.x1, w.x) AS x1, greatest(d.y1, w.y) AS y1, least(d.x2, w.x + 1100) AS x2, least(d.y2, w.y + 1100) AS y2
        FROM {detections} d
        JOIN (SELECT CAST(a.x AS BIGINT) AS x, CAST(b.y AS BIGINT) AS y
              FROM (VALUES (0), (450), (900)) a(x) CROSS JOIN (VALUES (0), (450), (900)) b(y)) w
          ON d.x1 < w.x + 1100 AND w.x < d.x2 AND d.y1 < w.y + 1100 AND w.y < d.y2""",
}


# Rows of one key meet before they are ranked: ranked where they are read, a whole input split is sorted at once, and spills.
DEALT = {"detections": {"lineitem": ("l_orderkey", "l_linenumber")}}
# Bytes of files that a partition of a dealt table stands for at most; about a million line items, which sort in 0.2 GB
DEALT_BYTES = 16 << 20


def dealt(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Rows of equal ``keys`` in one partition. Where spark.sql.shuffle.partitions is too small for the table's size, the size gives the number."""
    n = -(-df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() // DEALT_BYTES)
    return df.repartition(n, *keys) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df.repartition(*keys)


class Tables:
    """Tables of one folder by attribute: parquet tables and the adapters over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name in ADAPTERS:
            needs = {n: getattr(self, n) for n in sorted(set(re.findall(r"\{(\w+)\}", ADAPTERS[name])))}
            for n, keys in DEALT.get(name, {}).items():
                needs[n] = dealt(needs[n], keys)
            return self.spark.sql(ADAPTERS[name], **needs)
        raise AttributeError(name)


def duckdb_sql(text: str) -> str:
    """An oracle statement with the adapters that it names in braces put in front as common tables."""
    order: list[str] = []

    def need(body: str) -> None:
        for n in re.findall(r"\{(\w+)\}", body):
            if n in ADAPTERS and n not in order:
                need(ADAPTERS[n])
                order.append(n)

    need(text)
    bare = lambda s: re.sub(r"\{(\w+)\}", r"\1", s)
    ctes = ", ".join(f"{n} AS ({bare(ADAPTERS[n])})" for n in order)
    text = bare(text).strip()
    if not ctes:
        return text
    recursive = re.match(r"WITH\s+RECURSIVE\s+", text, re.I)
    plain = re.match(r"WITH\s+", text, re.I)
    if recursive:
        return f"WITH RECURSIVE {ctes}, {text[recursive.end():]}"
    if plain:
        return f"WITH {ctes}, {text[plain.end():]}"
    return f"WITH {ctes} {text}"
