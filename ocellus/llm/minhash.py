"""Document fingerprints: MinHash over word shingles, bands joined in Spark, Jaccard verified."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ocellus.llm.common import batch_shingles, chunks, mix, ordered_rows, partitions, text_or_empty, word_hashes, written
from ocellus.llm.linking import NO_ID, by_row, link_classes, restrict, shared_keys
from ocellus.llm.ngram_join import element_sets, signatures

_FIRST = -(1 << 63)


def permutations(count: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and offsets of multiply-shift hashing."""
    state = mix(np.arange(1, 2 * count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    return state[:count] | np.uint64(1), state[count:]


def minhashes(column: pa.Array, width: int = 5, count: int = 64) -> np.ndarray:
    """A row of ``count`` 32-bit minima per text; a text without words has the largest value throughout."""
    hashes, at = batch_shingles(*word_hashes(column), width)
    mul, add = permutations(count)
    out = np.full((len(column), count), 0xFFFFFFFF, dtype=np.uint32)
    filled = np.flatnonzero(np.diff(at))
    if len(filled):
        starts, block = at[filled], 1 << 14
        with np.errstate(over="ignore"):
            lo = 0
            while lo < len(filled):  # blocks that stay in cache; a longer text is taken whole
                hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + block)))
                end = starts[hi] if hi < len(filled) else at[-1]
                part, cut = hashes[starts[lo] : end], starts[lo:hi] - starts[lo]
                for k in range(count):
                    values = ((part * mul[k] + add[k]) >> np.uint64(32)).astype(np.uint32)
                    out[filled[lo:hi], k] = np.minimum.reduceat(values, cut)
                lo = hi
    return out


def fingerprint(minima: np.ndarray) -> list[str]:
    """Hexadecimal of the low 16 bits of each minimum."""
    low = (minima & np.uint32(0xFFFF)).astype(">u2")
    return [x.tobytes().hex() for x in low]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal 16-bit minima, an estimate of the Jaccard similarity."""
    return ((a & np.uint32(0xFFFF)) == (b & np.uint32(0xFFFF))).mean(axis=1)


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (id, text) dealt to ordered buckets, each followed by copies (tail) of the next bucket's first rows.

    Buckets start at sampled ids, so the row that follows a bucket's last one is
    known without a look at other buckets; each text is shuffled once.
    """
    ids = docs.select("oid")
    n = partitions(docs.sparkSession)
    row = ids.agg(F.min("oid").alias("least"), F.percentile_approx("oid", [i / n for i in range(1, n)] or [0.5], 100 * n).alias("cuts")).first()
    if row.least is None:
        cuts = np.array([_FIRST])
    else:
        cuts = np.unique(np.array([row.least, *(row.cuts or [])], dtype=np.int64))
    last = len(cuts)

    @F.pandas_udf("long")
    def place(oid: pd.Series) -> pd.Series:
        x = oid.to_numpy()
        at = np.searchsorted(cuts, x, side="right") - 1
        return pd.Series(2 * at + (cuts[at] == x))  # odd: the row opens its bucket

    here, opens = F.floor(F.col("place") / 2).cast("int"), F.col("place") % 2 == 1
    own = F.struct(here.alias("bucket"), F.lit(False).alias("tail"))
    before = F.struct(F.pmod(here - 1, F.lit(last)).cast("int").alias("bucket"), F.lit(True).alias("tail"))
    dealt = docs.withColumn("place", place("oid")).withColumn("to", F.explode(F.when(opens, F.array(own, before)).otherwise(F.array(own))))
    return (
        dealt.select("doc_id", "oid", "text", F.col("to.bucket").alias("bucket"), F.col("to.tail").alias("tail"))
        .repartitionById(last, "bucket")
        .sortWithinPartitions("bucket", "tail", "oid", "text")
    )


def edited_fingerprints(df: DataFrame, width: int = 5, count: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likenesses.

    The edited text is the text whose last floor(n/2) characters give way to the
    first as many of the next document by ascending id (after the last: the
    first). Null ids come first; rows with one id are ordered by text. A null text
    is empty; an empty text is like another empty text only.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    docs = docs.withColumn("oid", F.coalesce("doc_id", F.lit(_FIRST)))

    def made(batches):
        held = None  # the row whose successor has not come yet: id, text, minima
        ended = False
        for b in chunks(batches):
            if ended:
                continue  # only the first tail row matters
            tails = b.column("tail").to_pylist()
            if True in tails:
                b = b.slice(0, tails.index(True) + 1)
                ended = True
            ids, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
            minima = minhashes(b.column("text"), width, count)
            if held is not None:
                ids, texts = [held[0], *ids], [held[1], *texts]
                minima = np.concatenate((held[2], minima))
            held = (ids[-1], texts[-1], minima[-1:])
            n = len(ids) - 1
            if not n:
                continue
            edited = [t[: len(t) - len(t) // 2] + u[: len(t) // 2] for t, u in zip(texts, texts[1:])]
            changed = minhashes(pa.array(edited, pa.large_string()), width, count)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids[:n], pa.int64()), pa.array([len(t) for t in texts[:n]], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
                    pa.array(fingerprint(minima[:n])), pa.array(fingerprint(changed)),
                    pa.array(likeness(minima[:n], changed)), pa.array(likeness(minima[:n], minima[1:])),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    return with_next(docs).mapInArrow(
        made, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )


class Bands:
    """Band keys of a set's MinHash signature."""

    def __init__(self, bands: int, rows: int):
        self.bands, self.rows = bands, rows
        self.mul, self.add = permutations(bands * rows)

    def keys(self, s: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            least = ((s[:, None] * self.mul + self.add) >> np.uint64(32)).min(axis=0).reshape(self.bands, self.rows)
            key = np.arange(self.bands, dtype=np.uint64)
            for i in range(self.rows):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + least[:, i])
        return key


def near_duplicates(df: DataFrame, width: int = 5, num: int = 8, den: int = 10, bands: int = 16, rows: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, class_id (equal sets), component_id.

    Sets that share a band are candidates; their Jaccard similarity is verified on
    the whole sets. 16 bands of 4 rows find a pair of similarity 0.8 with
    probability 0.9998. Each row is a document of its own; a null id comes after all others.
    """
    rowed, numbered = ordered_rows(df, NO_ID, id_col, text_col)
    docs = rowed.filter("copy = 1").select(F.col("rid").alias("id"), "text")
    marks = written(signatures(docs, width, lambda: Bands(bands, rows).keys))

    def posts(reps, ids):
        keyed = reps.select("id", F.explode(F.array_distinct("keys")).alias("key"), F.lit(0.0).alias("alone"))
        return written(restrict(keyed, shared_keys(reps), "key"))

    linked = link_classes(marks, posts, lambda ids: element_sets(restrict(docs, ids), width), num, den)
    return by_row(rowed, numbered, linked).select("doc_id", "class_id", "component_id")
