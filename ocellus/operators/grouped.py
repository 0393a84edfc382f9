"""Whole groups in Python, many of them in one call, and pairs of overlapping boxes in numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_group(df: DataFrame, keys: list[str], f: Callable[[pd.DataFrame], pd.DataFrame | pa.RecordBatch], schema: str, packed: bool = False, then: Callable | None = None) -> DataFrame:
    """``f`` over frames of whole groups of the long columns ``keys``, sorted by them; rows without a key belong to no group.

    A frame holds as many groups as an Arrow batch, so small groups cost no call of
    their own; a group larger than a batch comes alone. With ``packed``, ``f`` returns
    Arrow batches of far more than it is given, so no partitions are joined for their small size; ``then`` goes on with a task's batches.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        last = None
        for b in batches:
            if not len(b):
                continue
            k = b[keys].to_numpy()
            other = np.flatnonzero((k != k[-1]).any(axis=1))
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut or (held and last != tuple(k[-1])):
                whole = pd.concat([*held, b.iloc[:cut]], ignore_index=True) if held else b.iloc[:cut].reset_index(drop=True)
                if len(whole):
                    yield f(whole)
                held = []
            held.append(b.iloc[cut:])
            last = tuple(k[-1])
        if held:
            yield f(pd.concat(held, ignore_index=True))

    known = df.filter(" AND ".join(f"{k} IS NOT NULL" for k in keys))
    if packed:
        tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number given is kept
        return known.repartition(tasks, *keys).sortWithinPartitions(*keys).mapInArrow(lambda batches: (then or iter)(run(b.to_pandas() for b in batches)), schema)
    return known.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, schema)


def list_column(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    """Lists of ``counts`` of the ``values`` each."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(values))


def flat_lists(batch: pa.RecordBatch, names: tuple[str, ...]) -> tuple[np.ndarray, ...]:
    """(counts, values of each column) of list columns of long whose lists are equally long."""
    columns = [batch.column(n) for n in names]
    return columns[0].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), *(c.flatten().to_numpy(zero_copy_only=False) for c in columns)


def within(counts: np.ndarray) -> np.ndarray:
    """0 .. n-1 for each of the counts n."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


def group_numbers(part: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """0, 0, 1 ... : which group a row of a sorted frame belongs to."""
    k = part[keys].to_numpy()
    return np.concatenate(([0], np.cumsum((k[1:] != k[:-1]).any(axis=1)))).astype(np.int64)


def box_pairs(group, x1, y1, x2, y2, block: int = 4_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of overlapping boxes of one group, each once, in blocks: boxes in order of x1 meet those that begin before they end."""
    if not len(x1):
        return
    order = np.lexsort((x1, group))
    base = np.asarray(group)[order] * (int(x2.max()) - int(x1.min()) + 1) - int(x1.min())
    begin, end, top, low = x1[order] + base, x2[order] + base, y1[order], y2[order]
    at = np.arange(len(order))
    count = np.maximum(np.searchsorted(begin, end, "left") - at - 1, 0)
    total = np.cumsum(count)
    lo = 0
    while lo < len(order):
        done = int(total[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, done + block, "right")))
        n = count[lo:hi]
        i = np.repeat(at[lo:hi], n)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        hit = (top[j] < low[i]) & (top[i] < low[j])
        yield order[i[hit]], order[j[hit]]
        lo = hi


def close_pairs(group, x1, y1, x2, y2, num: int, den: int, area=None) -> tuple[np.ndarray, np.ndarray]:
    """The pairs whose overlap exceeds num / den of their union; ``area`` is that of the boxes unless given."""
    area = (x2 - x1) * (y2 - y1) if area is None else area
    one, two = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for i, j in box_pairs(group, x1, y1, x2, y2):
        inter = (np.minimum(x2[i], x2[j]) - np.maximum(x1[i], x1[j])) * (np.minimum(y2[i], y2[j]) - np.maximum(y1[i], y1[j]))
        hit = inter * den > (area[i] + area[j] - inter) * num
        one.append(i[hit])
        two.append(j[hit])
    return np.concatenate(one), np.concatenate(two)


def least_reachable(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest of the nodes 0..n-1 in each node's component: labels fall along edges and jump to their label's label."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while True:
            ahead = label[label]
            if (ahead == label).all():
                break
            label = ahead
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label
