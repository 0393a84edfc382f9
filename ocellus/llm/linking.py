"""Connected components of a similarity join whose candidate keys may be shared by very many sets.

A caller gives every set a list of keys such that two sets that link share a
key. The sets under one key form a list; no list is ever expanded into pairs:

1. each set of a list is verified against the list's hub, one row per member;
   pairs whose bucket counts differ by more than linked sets can are dropped
   before any set is read;
2. the verified links give components; a list within one component is settled.
   The others get another hub, a few times;
3. in the lists that are still open the members outside the list's largest
   component are verified against all members, in blocks of bounded size; a block
   returns a spanning forest of its links.

Any link joins two members of a list. If both lie in the largest component they
are connected already, else step 3 verifies the pair; so no connection is lost.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ocellus.llm.common import drop, slices_of, tidy, written

#: Ids up to this many are broadcast (16 MB at most); more are joined by shuffle.
BROADCAST_IDS = 1_000_000
PROBE, BUILD = 1024, 4096
#: Hubs that a list gets before its members are compared in blocks.
ROUNDS = 3
#: In place of a null id, after all others.
NO_ID = (1 << 63) - 1
FLUSH = 2_000_000  # keys that a task holds before it deals them out


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for the ends of ``edges(a, b)``; component is the smallest id reachable.

    Labels fall to the least neighbouring label and then jump to the label's own
    label, so the rounds grow with the logarithm of the longest path.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("component")))
    while True:
        near = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("component").alias("near"))
        stepped = labels.join(near, labels.id == near.a, "left").select(
            "id", F.col("component").alias("old"), F.least("component", F.coalesce("near", "component")).alias("step")
        )
        stepped = written(stepped)
        if not stepped.filter("step <> old").limit(1).count():
            drop(both, stepped)
            return labels
        ahead = stepped.select(F.col("id").alias("key"), F.col("step").alias("jump"))
        jumped = written(stepped.join(ahead, stepped.step == ahead.key).select("id", F.least("step", "jump").alias("component")))
        drop(labels, stepped)
        labels = jumped


def restrict(df: DataFrame, ids: DataFrame, column: str = "id") -> DataFrame:
    """Rows of ``df`` whose ``column`` is in the written table ``ids``."""
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return df.join(ids, column, "left_semi")


def exclude(df: DataFrame, ids: DataFrame, column: str = "id") -> DataFrame:
    """Rows of ``df`` whose ``column`` is not in the written table ``ids``."""
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return df.join(ids, column, "left_anti")


def sketch(elements: np.ndarray) -> np.ndarray:
    """Counts of elements by bucket of their low bits, about four to a bucket, in 4096 buckets at most.

    The counts of two sets (after folding to the same number of buckets) differ in
    all by no more than the sets do; counts are cut off at 32767.
    """
    buckets = 1 << min(12, max(4, (len(elements) // 4).bit_length()))
    return np.minimum(np.bincount((elements & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets), 32767).astype(np.int16)


def folded(counts: np.ndarray, buckets: int) -> np.ndarray:
    """Sketches (along the last axis) over fewer buckets."""
    return counts.reshape(*counts.shape[:-1], -1, buckets).sum(axis=-2, dtype=np.int32)


def _lists(column) -> list[np.ndarray]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    at = column.offsets.to_numpy()
    flat = column.values.to_numpy()
    return [flat[i:j] for i, j in zip(at[:-1], at[1:])]


def _close_pairs(num: int, den: int):
    """(id, hub) of rows (id, hub, n, m, sketch, other) whose sketches let them link."""

    def close(batches):
        for b in batches:
            n, m = b.column("n").to_numpy(), b.column("m").to_numpy()
            pick = np.zeros(b.num_rows, dtype=bool)
            for i, (x, y) in enumerate(zip(_lists(b.column("sketch")), _lists(b.column("other")))):
                k = min(len(x), len(y))
                pick[i] = np.abs(folded(x, k) - folded(y, k)).sum() * (den + num) <= (n[i] + m[i]) * (den - num)
            yield b.select(["id", "hub"]).filter(pa.array(pick))

    return close


def shared_keys(rows: DataFrame) -> DataFrame:
    """(key) of the keys that two or more of rows(keys) have."""
    slices = slices_of(rows)

    def deal(batches):
        held: list[np.ndarray] = []
        count = 0

        def flush():
            keys, n = np.unique(np.concatenate(held).view(np.uint64), return_counts=True)
            where = (keys % np.uint64(slices)).astype(np.int64)
            order = np.argsort(where, kind="stable")
            cut = np.searchsorted(where[order], np.arange(slices + 1))
            out = []
            for k in np.flatnonzero(np.diff(cut)):
                part = order[cut[k] : cut[k + 1]]
                out.append((int(k), keys[part].tobytes(), np.packbits(n[part] > 1).tobytes()))
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], ["slice", "keys", "more"])

        for b in batches:
            flat = b.column("keys").flatten().to_numpy()
            if len(flat):
                held.append(flat)
                count += len(flat)
            if count >= FLUSH:
                yield flush()
                held, count = [], 0
        if held:
            yield flush()

    def settle(table: pa.Table) -> pa.Table:
        keys = [np.frombuffer(x, np.uint64) for x in table.column("keys").to_pylist()]
        more = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(k)) for x, k in zip(table.column("more").to_pylist(), keys)]
        keys, more = np.concatenate(keys), np.concatenate(more)
        order = np.argsort(keys, kind="stable")
        keys, more = keys[order], more[order].astype(np.int64)
        head = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        times = np.diff(np.append(head, len(keys))) + np.add.reduceat(more, head)
        return pa.table({"key": pa.array(keys[head[times > 1]].view(np.int64))})

    return written(rows.select("keys").mapInArrow(tidy(deal), "slice int, keys binary, more binary").groupBy("slice").applyInArrow(tidy(settle), "key long"))


def _block_survivors(num: int, den: int):
    """The probes and members of a block that may link with one of another component, by their sketches."""

    def survive(t: pa.Table) -> pa.Table:
        role, comp, n = (np.asarray(t.column(c).to_numpy()) for c in ("probe", "component", "n"))
        marks = _lists(t.column("sketch"))
        widths = np.array([len(x) for x in marks])
        probes, members = np.flatnonzero(role), np.flatnonzero(~role)
        stays = np.zeros(len(role), dtype=bool)
        for width in np.unique(widths[members]):
            group = members[widths[members] == width]
            tables = {int(width): np.stack([marks[i] for i in group]).astype(np.int32)}
            for i in probes:
                k = min(int(width), len(marks[i]))
                if k not in tables:
                    tables[k] = folded(tables[int(width)], k)
                apart = np.abs(tables[k] - folded(marks[i], k)).sum(axis=1, dtype=np.int64)
                hit = group[(apart * (den + num) <= (n[group] + n[i]) * (den - num)) & (comp[group] != comp[i])]
                stays[hit] = True
                stays[i] |= len(hit) > 0
        return t.select(["key", "probe_block", "build", "id", "component", "probe"]).filter(pa.array(stays))

    return tidy(survive)


def _block_links(num: int, den: int):
    def linked(groups):
        """Verify a block of probes against a block of members; a spanning forest of the links comes back."""
        t = groups
        role, ids, comp = (np.asarray(t.column(c).to_numpy()) for c in ("probe", "id", "component"))
        column = t.column("elements").combine_chunks()
        at = np.asarray(column.offsets.to_numpy(), dtype=np.int64)
        flat = np.asarray(column.values.to_numpy(), dtype=np.int64)
        size = np.diff(at)
        probes, members = np.flatnonzero(role), np.flatnonzero(~role)
        rows = np.concatenate([flat[at[i] : at[i + 1]] for i in probes])
        owner = np.repeat(np.arange(len(probes)), size[probes])
        order = np.argsort(rows, kind="stable")
        rows, owner = rows[order], owner[order]
        root = {}

        def find(x):
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        out = []
        for m in members:
            mine = flat[at[m] : at[m + 1]]
            lo, hi = np.searchsorted(rows, mine, "left"), np.searchsorted(rows, mine, "right")
            n = hi - lo
            if not n.any():
                continue
            hit = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            both = np.bincount(owner[hit], minlength=len(probes))
            union = size[probes] + size[m] - both
            for k in np.flatnonzero((den * both >= num * union) & (ids[probes] != ids[m])):
                a, b = find(int(comp[probes[k]])), find(int(comp[m]))
                if a != b:
                    root[max(a, b)] = min(a, b)
                    out.append((int(comp[probes[k]]), int(comp[m])))
        return pa.table({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})

    return tidy(linked)


def by_row(docs: DataFrame, numbered: bool, linked: DataFrame) -> DataFrame:
    """(doc_id, n, component_id, class_id) per row of docs(doc_id, rid), made by ``ordered_rows`` with NO_ID for null, from linked(id, n, rep, component)."""
    if not numbered:
        name = lambda c: F.nullif(F.col(c), F.lit(NO_ID))
        return linked.select(name("id").alias("doc_id"), "n", name("component").alias("component_id"), name("rep").alias("class_id"))
    ids = docs.filter("copy = 1").select("rid", "doc_id")
    named = lambda t, c, to: t.join(ids.select(F.col("rid").alias(c), F.col("doc_id").alias(to)), c)
    linked = named(named(linked, "component", "component_id"), "rep", "class_id")
    return docs.select("doc_id", F.col("rid").alias("id")).join(linked, "id").select("doc_id", "n", "component_id", "class_id")


def link_classes(rows: DataFrame, posts_of: Callable[[DataFrame, DataFrame], DataFrame], sets_of: Callable[[DataFrame], DataFrame], num: int, den: int) -> DataFrame:
    """(id, n, rep, component) per row of ``rows(id, n, sig1, sig2, sketch, ...)`` with distinct ids, linking sets of Jaccard >= num / den.

    Equal sets (equal n, sig1, sig2) form a class; only its smallest id, ``rep``,
    is compared. ``posts_of(reps, ids)`` gives written postings (id, key, alone),
    ``sets_of(ids)`` gives (id, elements) of representatives. ``component`` is the
    smallest id reachable; sets without elements stay alone.
    """
    classes = written(rows.filter("n > 0").groupBy("n", "sig1", "sig2").agg(F.min("id").alias("rep")))
    ids = classes.select(F.col("rep").alias("id"))
    reps = restrict(rows.filter("n > 0"), ids)
    posts = posts_of(reps, ids)
    # lists with the same members ask the same question: one of them is enough
    lists = posts.groupBy("key").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"))
    asked = written(lists.filter("size > 1").groupBy("x", "y", "size").agg(F.min("key").alias("key")).select("key"))
    members = written(posts.join(asked, "key"))
    drop(posts, asked)
    involved = written(members.select("id").distinct())
    marks = written(restrict(reps.select("id", "n", "sketch"), involved))
    sets = written(sets_of(involved))
    solved, waiting = _stars(members, marks, sets, num, den)
    if waiting is not None:
        solved = _merge(solved, _blocks(waiting, marks, sets, num, den))
    known = written(classes.join(solved, classes.rep == solved.id, "left").select("n", "sig1", "sig2", "rep", F.coalesce("component", "rep").alias("component")))
    drop(members, involved, marks, sets, classes)
    return rows.select("id", "n", "sig1", "sig2").join(known, ["n", "sig1", "sig2"], "left").select(
        "id", "n", F.coalesce("rep", "id").alias("rep"), F.coalesce("component", "id").alias("component")
    )


def _stars(members: DataFrame, marks: DataFrame, sets: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame | None]:
    """Components of the links between the members and the hub of each list, round by round, and the lists that are still open.

    The hub is the member with the smallest share of elements of its own: of a
    text and its edited copies that is the text itself. Later rounds take a hub
    outside the list's largest component.
    """
    least = F.min(F.struct("alone", "id"))["id"]
    placed = members.withColumn("component", F.col("id"))
    hubs = placed.groupBy("key").agg(least.alias("hub"))
    solved = None
    theirs = marks.select(F.col("id").alias("hub"), F.col("n").alias("m"), F.col("sketch").alias("other"))
    faraway = sets.select(F.col("id").alias("hub"), F.col("elements").alias("theirs"))
    both = F.size(F.array_intersect("elements", "theirs"))
    union = F.size("elements") + F.size("theirs") - both
    for _ in range(ROUNDS):
        centre = placed.select("key", F.col("id").alias("hub"), F.col("component").alias("centre"))
        pairs = placed.join(hubs, "key").join(centre, ["key", "hub"]).filter("component <> centre").select("id", "hub").distinct()
        size = den * F.least("n", "m") >= num * F.greatest("n", "m")
        tried = pairs.join(marks, "id").join(theirs, "hub").filter(size).select("id", "hub", "n", "m", "sketch", "other")
        stars = written(tried.mapInArrow(_close_pairs(num, den), "id long, hub long"))
        links = written(stars.join(sets, "id").join(faraway, "hub").filter(den * both >= num * union).select(F.col("id").alias("a"), F.col("hub").alias("b")))
        if solved is None:
            solved = components(links)
        else:
            at = lambda t, c: t.join(solved.select(F.col("id").alias(c), "component"), c, "left").select(
                *[x for x in t.columns if x != c], F.coalesce("component", c).alias(c))
            solved = _merge(solved, written(at(at(links, "a"), "b").select("a", "b").filter("a <> b").distinct()))
        drop(stars, links)
        # lists in more than one component, without the component that most members have in common, are open
        placed = members.join(solved, "id", "left").withColumn("component", F.coalesce("component", "id"))
        shares = placed.groupBy("key", "component").agg(F.count("*").alias("n"), F.min(F.struct("alone", "id")).alias("first"))
        largest = F.max(F.struct("n", "component"))["component"]
        opened = (
            shares.groupBy("key").agg(largest.alias("largest"), F.sum("n").alias("size"), F.max("n").alias("most"), F.count("*").alias("parts"))
            .filter("parts > 1 and size > 2").select("key", "largest", "size", (F.col("size") - F.col("most")).alias("outside"))
        )
        placed = written(placed.join(opened, "key"))
        if not placed.limit(1).count():
            drop(placed)
            return solved, None
        hubs = placed.filter("component <> largest").groupBy("key").agg(least.alias("hub"))
    return solved, placed


def _blocks(waiting: DataFrame, marks: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) between components of the open lists ``waiting(key, id, component, largest, size, outside)``, by blocks of bounded size."""
    spread = lambda n, width, seed: F.pmod(F.xxhash64(F.col("id"), F.lit(seed)), F.ceil(n / width)).cast("long")
    blocked = written(waiting.withColumns({"build": spread(F.col("size"), BUILD, 1), "probe_block": spread(F.col("outside"), PROBE, 2), "asks": F.col("component") != F.col("largest")}))
    asking = blocked.filter("asks").select("key", "probe_block", "id", "component")
    blocks = asking.select("key", "probe_block").distinct()
    builds = blocked.select("key", "build").distinct()
    sides = asking.join(builds, "key").select("key", "probe_block", "build", "id", "component", F.lit(True).alias("probe")).unionByName(
        blocked.drop("probe_block").join(blocks, "key").select("key", "probe_block", "build", "id", "component", F.lit(False).alias("probe"))
    )
    # sketches first: only sets with a partner that may link are read
    blocks = ["key", "probe_block", "build"]
    maybe = written(sides.join(marks, "id").groupBy(*blocks).applyInArrow(_block_survivors(num, den), "key long, probe_block long, build long, id long, component long, probe boolean"))
    later = written(maybe.join(sets, "id").groupBy(*blocks).applyInArrow(_block_links(num, den), "a long, b long").distinct())
    drop(waiting, blocked, maybe)
    return later


def _merge(first: DataFrame, later: DataFrame) -> DataFrame:
    """Components of the first links, joined by later links between components."""
    if not later.limit(1).count():
        return first
    solved = components(later)
    again = solved.select(F.col("id").alias("old"), F.col("component").alias("new"))
    moved = first.join(again, first.component == again.old, "left").select("id", F.coalesce("new", "component").alias("component"))
    alone = again.join(first.select("id"), again.old == F.col("id"), "left_anti").select(F.col("old").alias("id"), F.col("new").alias("component"))
    return written(moved.unionByName(alone))
