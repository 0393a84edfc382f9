"""Shared helpers: written tables that cut lineage, and vectorised word hashing over Arrow text."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import types
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder; on a cluster a
    missing setting is an error, since executors would not see each other's files.
    """
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="ocellus-")
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


_MADE: list[str] = []


def written(df: DataFrame, codec: str = "zstd", keep: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, whatever executor is lost later.

    The table stays until it is dropped by ``drop`` or, without ``keep``, by ``drop_all``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ocellus-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    if not keep:
        _MADE.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def drop(*tables: DataFrame) -> None:
    """Delete written tables that no plan reads any more."""
    for t in tables:
        _delete(t.sparkSession, t.scratch_path)
        if t.scratch_path in _MADE:
            _MADE.remove(t.scratch_path)
    if tables:
        free(tables[0].sparkSession)


def free(spark: SparkSession) -> None:
    """Let shuffle files of finished plans go: they stay until the driver has collected what refers to them."""
    gc.collect()
    spark._jvm.System.gc()


def drop_all(spark: SparkSession) -> None:
    """Delete all written tables: for a driver that has stored its last result elsewhere."""
    while _MADE:
        _delete(spark, _MADE.pop())
    free(spark)
    release()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices_of(df: DataFrame, each: int = 64 << 20) -> int:
    """Into how many slices hashes of ``df``'s texts are dealt: one per ``each`` bytes of input, but as many as shuffle partitions, and 48, at least.

    The size is Catalyst's estimate (that of the files), so nothing is read; where it knows none, the shuffle partitions decide.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(partitions(df.sparkSession), 48, size // each + 1 if size < 1 << 58 else 1)


def zipped(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value."""
    return pa.compress(b"".join(a.tobytes() for a in arrays), codec="zstd", asbytes=True)


def unzipped(blob: bytes, n: int, *kinds: str) -> list[np.ndarray]:
    """Arrays of ``n`` elements each from a compressed value."""
    size = sum(np.dtype(k).itemsize for k in kinds) * n
    raw, at, out = pa.decompress(blob, decompressed_size=size, codec="zstd", asbytes=True) if n else b"", 0, []
    for k in kinds:
        out.append(np.frombuffer(raw, k, n, at))
        at += out[-1].nbytes
    return out


def planes(x: np.ndarray) -> np.ndarray:
    """Bytes of integers, all first bytes first: the high bytes of small ones then compress to nothing."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).reshape(-1)


def from_planes(raw: np.ndarray, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(kind)


def dealt(where: np.ndarray, slices: int):
    """(slice, the places of its entries in order) of the slices that ``where`` names."""
    order = np.argsort(where, kind="stable")
    cut = np.searchsorted(where[order], np.arange(slices + 1))
    for k in np.flatnonzero(np.diff(cut)):
        yield int(k), order[cut[k] : cut[k + 1]]


_TRIMMED = [-1.0]


def release() -> None:
    """Give freed memory back to the system, once a second at most: workers live on from stage to stage."""
    if time.monotonic() - _TRIMMED[0] < 1:
        return
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass
    _TRIMMED[0] = time.monotonic()


def tidy(function):
    """``function``, for mapInArrow or applyInArrow, with its worker's freed memory given back after each group and at the end of a task."""

    def run(group):
        out = function(group)
        if isinstance(out, types.GeneratorType):
            return drained(out)
        release()
        return out

    def run_both(left, right):
        out = function(left, right)
        release()
        return out

    def drained(batches):
        try:
            for b in batches:
                yield b
                release()
        finally:
            release()

    return run_both if function.__code__.co_argcount == 2 else run


def text_or_empty(name: str):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def ordered_rows(df: DataFrame, null_id: int, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> tuple[DataFrame, bool]:
    """(doc_id, rid, copy, text, row): a number for each row that keeps the order of ids, and whether it had to be made.

    As long as no id is there twice, it is its own ``rid`` (``null_id`` for null).
    Else rows are numbered by id, those of one id by their text's SHA-256, and
    written once; rows of one id and text share a rid and are told apart by
    ``copy``, 1 for the first. ``row`` holds all columns with ``carry``.
    """
    docs = df.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(null_id)).alias("oid"), text_or_empty(text_col).alias("text"),
        *[F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")] * carry,
    )
    rest = ["text", *["row"] * carry]
    if not docs.groupBy("oid").count().filter("count > 1").limit(1).count():
        return docs.select("doc_id", F.col("oid").alias("rid"), F.lit(1).alias("copy"), *rest), False
    docs = docs.withColumn("sha", F.sha2(F.encode("text", "UTF-8"), 256))
    keys = docs.select("oid", "sha").distinct().repartitionByRange(slices_of(df), "oid", "sha").sortWithinPartitions("oid", "sha")
    keys = written(keys.withColumn("rid", F.monotonically_increasing_id()))
    copies = F.row_number().over(Window.partitionBy("rid").orderBy(F.lit(1)))
    return written(docs.join(keys, ["oid", "sha"]).select("doc_id", "rid", copies.alias("copy"), *rest)), True


# --- hashing -----------------------------------------------------------------

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit hashes (splitmix)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.empty(n + 1, dtype=np.uint64)
    out[0] = 1
    have = 1
    with np.errstate(over="ignore"):
        step = base
        while have <= n:  # doubling: base^(have..2*have) = base^(0..have) * base^have
            take = min(have, n + 1 - have)
            out[have : have + take] = out[:take] * step
            have += take
            step = step * step
    return out


_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BLOCK = 1 << 20
_POW = _powers(_BLOCK, _BASE)
_INV = _powers(_BLOCK, _INVERSE)


def arrow_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes and the offsets (one more than rows) of a string or binary array without nulls."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    lo, hi = (int(offsets[0]), int(offsets[-1])) if len(offsets) else (0, 0)
    body = np.frombuffer(data, dtype=np.uint8)[lo:hi] if data is not None else np.zeros(0, np.uint8)
    return body, offsets - lo


def word_hashes(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of a batch of texts, and the offsets of each text's words.

    Words are maximal runs of bytes other than 0x20 and 0x09-0x0D; in UTF-8 those
    bytes never occur inside another character. All steps are numpy over whole
    buffers: a prefix polynomial hash gives any word's hash by one subtraction.
    """
    body, offsets = arrow_bytes(column)
    if lower:
        body = _LOWER[body]
    space = _SPACE[body]
    edge = np.zeros(len(body) + 1, dtype=bool)  # a word can't run over the end of its text
    edge[offsets] = True
    inside = ~space
    before = np.empty(len(body), dtype=bool)
    if len(body):
        before[0] = False
        before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(len(body), dtype=bool)
    if len(body):
        after[-1] = False
        after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    out = np.empty(len(starts), dtype=np.uint64)
    lo = 0
    with np.errstate(over="ignore"):
        while lo < len(starts):
            # words are taken block by block so that the work arrays stay small
            base = starts[lo]
            hi = int(np.searchsorted(ends, base + _BLOCK, side="right"))
            if hi <= lo:  # one word longer than a block
                out[lo] = _long_hash(body[base : ends[lo]])
                lo += 1
                continue
            part = body[base : ends[hi - 1]].astype(np.uint64) + np.uint64(1)
            prefix = np.zeros(len(part) + 1, dtype=np.uint64)
            np.cumsum(part * _POW[: len(part)], out=prefix[1:])
            a, b = starts[lo:hi] - base, ends[lo:hi] - base
            out[lo:hi] = (prefix[b] - prefix[a]) * _INV[a]
            lo = hi
    return mix(out), np.searchsorted(starts, offsets)


def _long_hash(body: np.ndarray) -> np.uint64:
    total, step = np.uint64(0), np.uint64(1)
    with np.errstate(over="ignore"):
        for lo in range(0, len(body), _BLOCK):
            part = body[lo : lo + _BLOCK].astype(np.uint64) + np.uint64(1)
            total = total + (part * _POW[: len(part)]).sum(dtype=np.uint64) * step
            step = step * _POW[_BLOCK]
    return total


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the runs of ``width`` words of one text; a shorter text is one shingle, no words none."""
    n = len(words)
    if n == 0:
        return words
    k = min(width, n)
    with np.errstate(over="ignore"):
        out = np.full(n - k + 1, np.uint64(k), dtype=np.uint64)
        for i in range(k):
            out = mix(out * _BASE + words[i : n - k + 1 + i])
    return out


def text_batches(batches):
    """(batch, its text column with nulls as empty) of an Arrow iterator."""
    for b in batches:
        yield b, pc.fill_null(b.column("text").cast(pa.large_string()), "")


def batch_shingles(words: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """``shingles`` of many texts at once: hashes and the offsets of each text's shingles."""
    n = np.diff(offsets)
    count = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    out_offsets = np.concatenate(([0], np.cumsum(count)))
    # the word at which each shingle starts
    at = np.arange(out_offsets[-1]) - np.repeat(out_offsets[:-1] - offsets[:-1], count)
    size = np.repeat(np.minimum(n, width), count)
    out = size.astype(np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            inside = size > i
            if inside.all():
                out = out * _BASE + words[at + i]
            else:
                out[inside] = out[inside] * _BASE + words[at[inside] + i]
    return mix(out), out_offsets


def chunks(batches, text: str = "text", limit: int = 1 << 20):
    """Slices of Arrow batches with about ``limit`` bytes of text each (a longer text stands alone)."""
    for b in batches:
        column = b.column(text)
        if not b.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        lo = 0
        ends = np.cumsum(sizes)
        while lo < b.num_rows:
            base = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield b.slice(lo, hi - lo)
            lo = hi
