"""Exact dedup by content sort."""

from __future__ import annotations

import hashlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ocellus.llm.common import UPPER, partitions, text_or_empty, tidy, written

_RUN = "part long, edge_text string, sha string, n long, last long, ids array<long>"


def _runs(batches, payload: bool):
    """Runs of neighbours with equal normalised text, in a partition sorted by (prefix, digest, text, id).

    A run may go on in a neighbouring partition only if its (prefix, digest) is
    that of the partition's first or last row; those runs carry their text, so
    that they can be compared in full. Only the runs of one digest are held.
    """
    part = TaskContext.get().partitionId()
    first_key = key = None
    held: list[dict] = []  # finished and open runs of the current key
    out: list[dict] = []

    def flush(edge: bool):
        for r in held:
            body = r.pop("norm")
            r["sha"] = hashlib.sha256(body).hexdigest()
            r["edge_text"] = body.decode() if edge else None
            out.append(r)
        held.clear()

    def batch_of(rows):
        types = {"part": pa.int64(), "edge_text": pa.string(), "sha": pa.string(), "n": pa.int64(), "last": pa.int64(), "ids": pa.list_(pa.int64())}
        cols = [pa.array([r[k] for r in rows], t) for k, t in types.items()]
        names = list(types)
        if payload:
            cols.append(pa.concat_arrays([r["row"] for r in rows]))
            names.append("row")
        return pa.RecordBatch.from_arrays(cols, names)

    for b in batches:
        norm = pc.ascii_lower(b.column("text")).cast(pa.large_binary())
        n = b.num_rows
        if not n:
            continue
        new = [True] * n
        if n > 1:
            same = pc.equal(norm.slice(1), norm.slice(0, n - 1)).to_pylist()
            new[1:] = [not x for x in same]
        head = norm[0].as_py()
        new[0] = not (held and held[-1]["norm"] == head)
        cuts = [i for i in range(n) if new[i]]
        spans = ([(0, cuts[0] if cuts else n, False)] if not new[0] else []) + [(i, j, True) for i, j in zip(cuts, [*cuts[1:], n])]
        pre, dig, ids = b.column("prefix"), b.column("digest"), b.column("id")
        for i, j, fresh in spans:
            got = ids.slice(i, j - i).to_pylist()
            if fresh:
                k = (pre[i].as_py(), dig[i].as_py())
                if first_key is None:
                    first_key = k
                if k != key:
                    flush(key is not None and key == first_key)
                    key = k
                held.append({"part": part, "norm": norm[i].as_py(), "n": 0, "last": None, "ids": []})
            r = held[-1]
            r["n"] += len(got)
            r["ids"] += got
            r["last"] = got[-1]
            if payload:
                r["row"] = b.column("row").slice(j - 1, 1)
        if len(out) >= 2000:
            yield batch_of(out)
            out = []
    flush(True)
    if out:
        yield batch_of(out)


def equal_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", carry: bool = False) -> DataFrame:
    """One row per run of equal texts in a partition of the content sort.

    Columns: ids (array), sha, group_size, keep_id, keeps (this run holds the row
    that stays), and row (the run's kept row as a struct) with ``carry``.
    Texts are equal when identical after lower-casing A-Z; null counts as empty.

    The range partitioning samples splitters on (first 24 characters, digest,
    id), so a group of any size is spread over partitions by id. A group cut by a
    partition's end is joined again by comparing the full texts of edge runs.
    """
    sign = -1 if keep == "smallest" else 1
    norm = F.translate(F.col("text"), UPPER, UPPER.lower())
    cols = [text_or_empty(text_col).alias("text"), (F.col(id_col).cast("long") * sign).alias("id")]
    if carry:
        cols.append(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    keyed = df.select(*cols).withColumns({
        "prefix": F.translate(F.substring("text", 1, 24), UPPER, UPPER.lower()),
        "digest": F.xxhash64(F.lower("text")),  # equal normalised texts agree on it; it only orders them
    })
    order = [F.col("prefix"), F.col("digest")]
    placed = (
        keyed.repartitionByRange(partitions(df.sparkSession), *order, F.col("id").asc_nulls_first())
        .withColumn("norm", norm)
        .sortWithinPartitions(*order, "norm", F.col("id").asc_nulls_first())
        .drop("norm")
    )
    schema = T._parse_datatype_string(_RUN)
    if carry:
        schema = schema.add("row", placed.schema["row"].dataType)
    runs = written(placed.mapInArrow(tidy(lambda batches: _runs(batches, carry)), schema))
    edges = (
        runs.filter(F.col("edge_text").isNotNull())
        .groupBy("edge_text")
        .agg(F.first("sha").alias("e_sha"), F.sum("n").alias("e_n"), F.max(F.struct("last", "part")).alias("e_last"))
        .drop("edge_text")
    )
    # at most two digests per partition carry edges, but the engine, not a hint, picks the join
    whole = runs.drop("edge_text").join(edges, F.col("sha") == F.col("e_sha"), "left")
    last = F.coalesce(F.col("e_last"), F.struct("last", "part"))
    return whole.select(
        *(["row"] if carry else []),
        F.transform("ids", lambda x: x * sign).alias("ids"),
        "sha",
        F.coalesce("e_n", "n").alias("group_size"),
        (last["last"] * sign).alias("keep_id"),
        (last["part"] == F.col("part")).alias("keeps"),
    )


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    ``keep`` is "smallest" or "largest" identifier. Of rows that repeat the kept
    identifier and text exactly one is kept. A null identifier ranks below all
    others for "largest" and for "smallest" alike. An empty table gives no rows.
    """
    runs = equal_runs(df, id_col, text_col, keep)
    each = runs.select("*", F.posexplode("ids").alias("at", "doc_id"))
    return each.select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("keeps") & (F.col("at") == F.size("ids") - 1)).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def distinct_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows that stay, with all their columns."""
    return equal_runs(df, id_col, text_col, keep, carry=True).filter("keeps").select("row.*")
