"""N-gram Jaccard join: a size-aware heavy-light join of shingle sets."""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ocellus.llm.common import batch_shingles, chunks, dealt, drop, mix, ordered_rows, slices_of, text_or_empty, tidy, unzipped, word_hashes, written, zipped
from ocellus.llm.linking import NO_ID, by_row, exclude, link_classes, restrict, shared_keys, sketch

#: Sets up to this size can be light: enumerating more subsets than theirs never pays.
MOST_LIGHT = 24
#: What scanning one entry of an inverted list costs, in units of one enumerated subset.
SCAN_COST = 1.0
FLUSH = 1_000_000  # elements that a task holds before it deals them out
#: Entries of one element that may meet in a slice: a task with more than its share keeps them and sends a mark.
ELEMENT_ENTRIES = 1_000_000
HOT = 255  # the rank of elements that a task has marked


class Scheme:
    """Which keys sets post so that any two sets of Jaccard similarity >= num / den share one.

    Light sets enumerate subsets: linking sets share their intersection, which
    lacks at most a tenth (at 0.9) of either, so all subsets of the possible
    intersection sizes are keys. Heavy sets stand in inverted lists of elements,
    rare ones first: with all elements in one order, linking sets share one of
    their first n - least(n) + 1. A pair is found by subsets if its smaller set is
    light, else by lists.
    """

    def __init__(self, num: int, den: int, light: int = 0):
        self.num, self.den, self.light = num, den, light

    def least(self, n: int) -> int:
        """The fewest common elements, and the smallest partner, of a set of ``n``."""
        return -(-n * self.num // self.den)

    def subsets(self, n: int) -> int:
        return sum(comb(n, k) for k in range(n - self.least(n) + 1))

    def enumerates(self) -> int:
        """The largest set that may have a light partner."""
        return self.light * self.den // self.num

    def keys(self, s: np.ndarray) -> np.ndarray:
        """Subset keys of the set of the sorted distinct hashes ``s``."""
        n, out = len(s), [np.zeros(0, np.uint64)]
        low = self.least(n)
        if not n or low > self.light:
            return out[0]
        with np.errstate(over="ignore"):
            mixed = mix(s)
            total = mixed.sum(dtype=np.uint64)
            for size in range(low, min(n, self.light) + 1):
                gone = [mixed[list(c)].sum(dtype=np.uint64) for c in combinations(range(n), n - size)] if size < n else [np.uint64(0)]
                out.append(mix(mix(total - np.array(gone, dtype=np.uint64)) + np.uint64(size)))
        return np.concatenate(out)


def _sets(batch: pa.RecordBatch, width: int):
    hashes, at = batch_shingles(*word_hashes(batch.column("text")), width)
    for i in range(batch.num_rows):
        yield np.unique(hashes[at[i] : at[i + 1]])


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _listed(parts: list[np.ndarray], kind) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(np.concatenate(parts), kind))


def signatures(docs: DataFrame, width: int, key_maker) -> DataFrame:
    """(id, n, sig1, sig2, sketch, keys) per row of docs(id, text); ``key_maker()`` gives a function from a set to its keys."""

    def made(batches):
        keys_of = key_maker()
        for b in chunks(batches):
            n, one, two, keys, sketches = [], [], [], [], []
            with np.errstate(over="ignore"):
                for s in _sets(b, width):
                    n.append(len(s))
                    one.append(s.sum(dtype=np.uint64))
                    two.append((mix(s + np.uint64(1)) * (s | np.uint64(1))).sum(dtype=np.uint64))
                    sketches.append(sketch(s))
                    keys.append(_signed(keys_of(s)) if len(s) else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(n, pa.int64()), pa.array(_signed(np.array(one, np.uint64))), pa.array(_signed(np.array(two, np.uint64))),
                 _listed(sketches, pa.int16()), _listed(keys, pa.int64())],
                ["id", "n", "sig1", "sig2", "sketch", "keys"],
            )

    return docs.mapInArrow(tidy(made), "id long, n long, sig1 long, sig2 long, sketch array<smallint>, keys array<long>")


def element_sets(docs: DataFrame, width: int) -> DataFrame:
    """(id, elements): the distinct shingle hashes of docs(id, text)."""

    def made(batches):
        for b in chunks(batches):
            yield pa.RecordBatch.from_arrays([b.column("id"), _listed([_signed(s) for s in _sets(b, width)], pa.int64())], ["id", "elements"])

    return docs.mapInArrow(tidy(made), "id long, elements array<long>")


# --- inverted lists ----------------------------------------------------------------

_SENT = "slice int, piece long, n long, entries binary, docs array<struct<id:long,n:long>>"
_DOC = pa.struct([("id", pa.int64()), ("n", pa.int64())])
_KINDS = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.list_(_DOC))
_MARK = np.uint32(0xFFFFFFFF)


def _deal_elements(width: int, slices: int, share: int):
    """Elements of a task's sets, packed per slice of their hash; a piece's documents travel in a row of their own."""

    def deal(batches):
        piece = TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        count = 0

        def flush():
            nonlocal held, count, piece
            ids = np.array([i for i, _ in held], np.int64)
            sizes = np.array([len(s) for _, s in held], np.int64)
            elements = np.concatenate([s for _, s in held])
            doc = np.repeat(np.arange(len(held), dtype=np.uint32), sizes)
            held, count = [], 0
            order = np.argsort(elements, kind="stable")
            elements, doc = elements[order], doc[order]
            head = np.flatnonzero(np.concatenate(([True], elements[1:] != elements[:-1])))
            times = np.diff(np.append(head, len(elements)))
            hot = np.repeat(times > share, times)
            marks = elements[head[times > share]]
            own = zipped(elements[hot], doc[hot], np.full(int(hot.sum()), HOT, np.uint8)) if hot.any() else None
            elements, doc = np.concatenate((elements[~hot], marks)), np.concatenate((doc[~hot], np.full(len(marks), _MARK, np.uint32)))
            rows = [(k, piece, len(part), zipped(elements[part], doc[part]), None) for k, part in dealt((elements % np.uint64(slices)).astype(np.int64), slices)]
            docs = [{"id": i, "n": n} for i, n in zip(ids.tolist(), sizes.tolist())]
            rows.append((slices + piece % slices, piece, int(hot.sum()), own, docs))
            piece += 1
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_KINDS)], ["slice", "piece", "n", "entries", "docs"])

        for b in chunks(batches):
            for i, s in zip(b.column("id").to_pylist(), _sets(b, width)):
                if len(s):
                    held.append((i, s))
                    count += len(s)
            if count >= FLUSH:
                yield flush()
        if held:
            yield flush()

    return tidy(deal)


def _rank_elements(slices: int):
    """Of a slice: the elements that two or more sets have, sent back to their pieces with a rank that grows with how many do."""

    def rank(table: pa.Table) -> pa.Table:
        if table.column("slice")[0].as_py() >= slices:
            return table.drop_columns(["slice"])
        sizes, pieces = table.column("n").to_pylist(), table.column("piece").to_pylist()
        parts = [unzipped(b, n, "<u8", "<u4") for b, n in zip(table.column("entries").to_pylist(), sizes)]
        elements, doc = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        piece = np.repeat(np.arange(len(sizes)), sizes)
        order = np.argsort(elements, kind="stable")
        head = np.concatenate(([True], elements[order][1:] != elements[order][:-1]))
        group = np.cumsum(head) - 1
        times = np.bincount(group)
        marked = np.bincount(group, weights=doc[order] == _MARK) > 0
        level = np.where(marked, HOT, np.minimum(HOT - 1, 1 + (8 * np.log2(np.maximum(times, 1))).astype(np.int64)))
        back = np.empty(len(elements), np.uint8)
        back[order] = np.where(times > 1, level, 0)[group]
        stays = np.flatnonzero((back > 0) & (doc != _MARK))
        ends = np.searchsorted(piece[stays], np.arange(len(sizes) + 1))
        out = []
        for k, p in enumerate(pieces):
            part = stays[ends[k] : ends[k + 1]]
            if len(part):
                out.append((p, len(part), zipped(elements[part], doc[part], back[part]), None))
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate(_KINDS[1:])], names=["piece", "n", "entries", "docs"])

    return tidy(rank)


def _first_elements(num: int, den: int):
    """Of a piece: the elements under which each set stands in inverted lists, and what scanning those lists costs."""

    def first(table: pa.Table) -> pa.Table:
        docs = next(x for x in table.column("docs") if x.is_valid).values
        ids, n = (np.asarray(docs.field(k)) for k in ("id", "n"))
        parts = [unzipped(b, k, "<u8", "<u4", "<u1") for b, k in zip(table.column("entries").to_pylist(), table.column("n").to_pylist()) if k]
        elements, doc, level = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, t) for i, t in enumerate(("<u8", "<u4", "<u1")))
        order = np.lexsort((elements, level, doc))
        elements, doc, level = elements[order], doc[order].astype(np.int64), level[order]
        have = np.bincount(doc, minlength=len(ids))
        first_of = n - -(-n * num // den) + 1
        # elements that no other set has come first and need no list
        wanted = np.maximum(0, first_of - (n - have))
        place = np.arange(len(doc)) - np.repeat(np.cumsum(have) - have, have)
        pick = place < wanted[doc]
        cost = np.bincount(doc[pick], weights=2.0 ** ((level[pick].astype(float) - 1) / 8), minlength=len(ids))
        posted = np.bincount(doc[pick], minlength=len(ids))
        some = np.flatnonzero(n > 0)
        at = np.concatenate(([0], np.cumsum(posted[some])))
        return pa.table({
            "id": pa.array(ids[some]), "n": pa.array(n[some]), "alone": pa.array((n - have)[some] / n[some]), "cost": pa.array(cost[some].astype(float)),
            "keys": pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(_signed(elements[pick]))),
        })

    return tidy(first)


def inverted_lists(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """(id, n, alone, cost, keys) of docs(id, text): the rarest elements that a linking set must share one of.

    ``alone`` is the share of elements that no other set has, ``cost`` the length of
    the lists under ``keys``. Elements are counted over all sets.
    """
    slices = slices_of(docs)
    share = max(1, ELEMENT_ENTRIES // max(1, docs.rdd.getNumPartitions()))
    sent = docs.mapInArrow(_deal_elements(width, slices, share), _SENT)
    ranked = sent.groupBy("slice").applyInArrow(_rank_elements(slices), _SENT.split(", ", 1)[1])
    return ranked.groupBy("piece").applyInArrow(_first_elements(num, den), "id long, n long, alone double, cost double, keys array<long>")


def light_up_to(lists: DataFrame, scheme: Scheme) -> int:
    """The boundary: the largest size up to which enumerating subsets costs no more than scanning the lists of such sets."""
    scan = {r["n"]: r["cost"] for r in lists.filter(F.col("n") <= MOST_LIGHT).groupBy("n").agg(F.avg("cost").alias("cost")).collect()}
    size = 0
    while size < MOST_LIGHT and (size + 1 not in scan or scheme.subsets(size + 1) <= max(1.0, SCAN_COST * scan[size + 1])):
        size += 1
    return size


def _posts(docs: DataFrame, width: int, num: int, den: int):
    """Postings (id, key, alone) of the representatives: of subsets that two sets have, and of the first elements of heavy sets."""

    def posts(reps: DataFrame, ids: DataFrame) -> DataFrame:
        lists = written(inverted_lists(restrict(docs, ids), width, num, den))
        scheme = Scheme(num, den, light_up_to(lists, Scheme(num, den)))
        least = scheme.enumerates()

        def enumerated(batches):
            for b in batches:
                keys = [_signed(scheme.keys(np.array(x, np.int64).view(np.uint64))) for x in b.column("keys").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("id"), _listed(keys, pa.int64())], ["id", "keys"])

        heavy = lists.filter((F.col("n") > scheme.light) & (F.size("keys") > 0)).select("id", F.explode("keys").alias("key"), "alone")
        small = written(reps.filter((F.col("n") <= least) & (F.size("keys") > 0)).select("id", "keys").mapInArrow(enumerated, "id long, keys array<long>"))
        light = restrict(small.select("id", F.explode(F.array_distinct("keys")).alias("key")), shared_keys(small), "key").withColumn("alone", F.lit(1.0))
        out = written(heavy.unionByName(light))
        drop(lists, small)
        return out

    return posts


def linked_rows(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """(id, n, rep, component) of docs(id, text) with distinct ids."""
    most = MOST_LIGHT * den // num
    rows = written(signatures(docs, width, lambda: lambda s: s if len(s) <= most else s[:0]))
    return link_classes(rows, _posts(docs, width, num, den), lambda ids: element_sets(restrict(docs, ids), width), num, den)


def ngram_links(df: DataFrame, width: int = 5, num: int = 8, den: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, class_id.

    Shingles are runs of ``width`` words, compared by 64-bit hashes. class_id is
    the smallest id with the same set, component_id the smallest id reachable over
    links. A null or empty text has no shingles and links with nothing. Each row
    is a document of its own, also if ids repeat; a null id comes after all others
    and shows as null. An empty table gives no rows; other columns are not read;
    a text is held whole in a task.
    """
    docs, numbered = ordered_rows(df, NO_ID, id_col, text_col)
    linked = linked_rows(docs.filter("copy = 1").select(F.col("rid").alias("id"), "text"), width, num, den)
    return by_row(docs, numbered, linked).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "class_id")


def distinct_near_documents(df: DataFrame, width: int = 5, num: int = 8, den: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` without near duplicates: of each component the row of smallest id stays (a null id is the largest).

    Of rows with one id and text one stays; of rows with one id and different
    texts that link, the one whose text has the smaller SHA-256. Texts without
    words link with nothing, so they stay. All columns are kept as they are.
    """
    docs, _ = ordered_rows(df, NO_ID, id_col, text_col, carry=True)
    docs = docs.filter("copy = 1")
    linked = linked_rows(docs.select(F.col("rid").alias("id"), "text"), width, num, den)
    gone = written(linked.filter("component <> id").select(F.col("id").alias("rid")))
    return exclude(docs, gone, "rid").select("row.*")
