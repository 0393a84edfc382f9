"""Mixing sources to target weights by Sainte-Lague apportionment."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ocellus.llm.common import WORD, text_or_empty, written


def sainte_lague(votes, seats: int) -> np.ndarray:
    """Seats by highest quotients votes / (2 s + 1); equal quotients go to the earlier party.

    Starts from the rounded shares and then gives or takes single seats by the
    extreme quotient, which ends at the same allocation as handing out one by one.
    """
    votes = np.asarray(votes, dtype=np.float64)
    out = np.zeros(len(votes), dtype=np.int64)
    total = votes.sum()
    if seats <= 0 or total <= 0:
        return out
    out = np.maximum(0, np.floor(votes * (seats / total) + 0.5)).astype(np.int64)
    short = int(seats - out.sum())
    if short > 0:
        heap = [(-v / (2 * s + 1), i) for i, (v, s) in enumerate(zip(votes, out))]
        heapq.heapify(heap)
        for _ in range(short):
            _, i = heap[0]
            out[i] += 1
            heapq.heapreplace(heap, (-votes[i] / (2 * out[i] + 1), i))
    elif short < 0:
        heap = [(v / (2 * s - 1), -i) for i, (v, s) in enumerate(zip(votes, out)) if s]
        heapq.heapify(heap)
        for _ in range(-short):
            _, i = heapq.heappop(heap)
            out[-i] -= 1
            if out[-i]:
                heapq.heappush(heap, (votes[-i] / (2 * out[-i] - 1), i))
    return out


def targets(sizes: list[int], weights: list[float], share: float = 1.5, most: float = 2.0) -> list[float]:
    """Split share * sum(sizes) by weight; no target above most * its size, the excess reshared by weight."""
    caps = [most * s for s in sizes]
    left, weight = share * sum(sizes), float(sum(weights))
    out = [0.0] * len(sizes)
    # a source that reaches its cap at a low level per weight is settled first
    order = sorted(range(len(sizes)), key=lambda i: (caps[i] / weights[i], i))
    for k, i in enumerate(order):
        level = left / weight
        if caps[i] / weights[i] <= level:
            out[i] = float(caps[i])
            left -= caps[i]
            weight -= weights[i]
        else:
            for j in order[k:]:
                out[j] = level * weights[j]
            break
    return out


def mixed(df: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: int = 2, block: int = 8, shard_docs: int = 4096, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", broadcast_sources: int = 100_000, digest: bool = False) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, taken, passes, from_1, to_1, to_2.

    The mix takes ``passes`` whole copies of a document, its words [from_1, to_1)
    and its words [0, to_2). Sources (by code point, null last) get the weights
    in turn. Blocks of ``block`` words are allotted to the sources by highest
    quotients, and each source's blocks to its shards in the same way; a shard
    holds about ``shard_docs`` documents of all sources, whatever the corpus size.
    Within a shard a source's documents stand in seeded order, cut into blocks;
    a seeded block starts the run of blocks that the quota takes.

    The per-source totals, a row per source, are the mixing plan and come to the
    driver; the plan is broadcast up to ``broadcast_sources`` sources and joined by
    a shuffle beyond. An empty table gives no rows; a null text is empty; a source
    whose texts are all empty has target and taken 0. Rows of one id but other
    texts fall into shards of their own; equal rows are mixed each for itself. With
    ``digest`` each row also carries the 64-bit hash of its text.
    """
    extra = ["digest"] if digest else []
    sized = written(df.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(text_or_empty(text_col)).alias("digest"),
    ))
    totals = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("docs")).collect()
    totals.sort(key=lambda r: (r.source is None, r.source or ""))
    sizes = [r["size"] for r in totals]
    aims = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share, most)
    blocks = sainte_lague(aims, round(sum(aims) / block)).tolist()
    spark = df.sparkSession
    plan = spark.createDataFrame(
        [(r.source, int(s), float(t), int(q)) for r, s, t, q in zip(totals, sizes, aims, blocks)],
        "source string, source_size long, target double, blocks long",
    )
    shards = max(1, -(-sum(r.docs for r in totals) // shard_docs))
    draw = lambda *c: F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(x.cast("string"), F.lit("")) for x in c])), 1, 15), 16, 10).cast("long")
    docs = sized.withColumn("draw", draw(F.col("doc_id"), F.col("digest"))).withColumn("shard", F.col("draw") % shards)
    per_shard = docs.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"))

    def quotas(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("shard", ignore_index=True)
        part["quota"] = sainte_lague(part["shard_size"].to_numpy(), int(part["blocks"].iloc[0]))
        return part[["source", "shard", "shard_size", "source_size", "target", "quota"]]

    quota = (
        per_shard.join(F.broadcast(plan) if len(totals) <= broadcast_sources else plan, per_shard.source.eqNullSafe(plan.source), "inner").drop(plan.source)
        .groupBy("source").applyInPandas(quotas, "source string, shard long, shard_size long, source_size long, target double, quota long")
    )
    here = Window.partitionBy("source", "shard").orderBy("draw", "doc_id", "size")
    placed = docs.withColumn("end", F.sum("size").over(here.rowsBetween(Window.unboundedPreceding, 0))).alias("d").join(
        quota.alias("q"), F.col("d.source").eqNullSafe(F.col("q.source")) & (F.col("d.shard") == F.col("q.shard"))
    )
    total = F.col("shard_size")
    count = F.greatest(F.lit(1), F.ceil(total / block))
    rows = placed.select(
        "doc_id", "d.source", "size", "source_size", "target", F.col("end"), total,
        F.least(F.col("quota") * block, total * most).alias("words"),
        (draw(F.col("d.source"), F.col("d.shard")) % count * block).alias("start"), *extra,
    )
    rows = rows.withColumns({
        "passes": F.when(F.col("shard_size") > 0, F.floor(F.col("words") / F.col("shard_size"))).otherwise(0).cast("long"),
        "begin": F.col("end") - F.col("size"),
    }).withColumn("rest", F.col("words") - F.col("passes") * F.col("shard_size"))
    clip = lambda x: F.least(F.greatest(x - F.col("begin"), F.lit(0)), F.col("size"))
    rows = rows.withColumns({
        "from_1": clip(F.col("start")),
        "to_1": clip(F.col("start") + F.col("rest")),
        "to_2": clip(F.col("start") + F.col("rest") - F.col("shard_size")),
    })
    return rows.select(
        "doc_id", "source", "size", "source_size", "target",
        (F.col("passes") * F.col("size") + F.col("to_1") - F.col("from_1") + F.col("to_2")).alias("taken"),
        "passes", "from_1", "to_1", "to_2", *extra,
    )


def mixture(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **plan) -> DataFrame:
    """The rows of the mix with all columns of ``df``: whole copies, and texts cut to the words taken.

    Rows that repeat an id and text are matched one to one. Documents of which no
    word is taken, those without words included, do not appear.
    """
    import re

    import pyarrow as pa
    from pyspark.sql import types as T

    digest = F.xxhash64(text_or_empty(text_col))
    picked = mixed(df, id_col=id_col, text_col=text_col, source_col=source_col, digest=True, **plan)
    plans = picked.filter("taken > 0").groupBy("doc_id", "digest").agg(F.collect_list(F.struct("passes", "size", "from_1", "to_1", "to_2")).alias("plans"))
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")
    rows = df.select(row, F.col(id_col).cast("long").alias("id"), digest.alias("digest")).withColumn(
        "turn", F.row_number().over(Window.partitionBy("id", "digest").orderBy(F.lit(1)))
    )
    both = rows.join(plans, rows.id.eqNullSafe(plans.doc_id) & (rows.digest == plans.digest)).filter(F.col("turn") <= F.size("plans"))
    piece_name = "_piece"
    while piece_name in df.columns:
        piece_name += "_"
    p = F.element_at("plans", F.col("turn"))
    piece = lambda lo, hi: F.struct(lo.cast("long").alias("lo"), hi.cast("long").alias("hi"), p["size"].alias("size"))
    pieces = F.filter(
        F.concat(F.array_repeat(piece(F.lit(0), p["size"]), p["passes"].cast("int")), F.array(piece(p["from_1"], p["to_1"]), piece(F.lit(0), p["to_2"]))),
        lambda x: x["hi"] > x["lo"],
    )
    out = both.select("row.*", F.explode(pieces).alias(piece_name))
    schema = T.StructType(out.schema.fields[:-1])
    word = re.compile(WORD)

    def cut(batches):
        for b in batches:
            texts, changed = b.column(text_col).to_pylist(), False
            for i, x in enumerate(b.column(piece_name).to_pylist()):
                if x["lo"] == 0 and x["hi"] == x["size"]:
                    continue
                changed = True
                start = end = 0
                for k, m in enumerate(word.finditer(texts[i])):
                    if k == x["lo"]:
                        start = m.start()
                    if k == x["hi"] - 1:
                        end = m.end()
                        break
                texts[i] = texts[i][start:end]
            cols = [pa.array(texts, c.type) if n == text_col and changed else c for n, c in zip(b.schema.names[:-1], b.columns[:-1])]
            yield pa.RecordBatch.from_arrays(cols, b.schema.names[:-1])

    return out.mapInArrow(cut, schema)
