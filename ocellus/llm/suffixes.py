"""Removal of repeated byte strings by a hash-compared suffix sort.

A string of ``span`` bytes that starts earlier elsewhere is found in four steps.

Anchors. Of the grams (half a span long) of a window of ``span`` bytes the one of
least hash (the last of equals) is the window's anchor. Equal windows have equal
anchors at the same place, so only windows whose anchors agree need comparing.
Windows that follow each other and share an anchor make a run.

Runs. Runs are dealt by anchor. A run equal to an earlier one repeats it
throughout; only the first stays. An anchor that then has more than one run is open.

Suffixes. For the open anchors the bytes around them are sorted as suffixes that
start at the anchor, to the right and to the left: a mergesort whose comparisons
find the common extension by binary search over prefix polynomial hashes. In
sorted order the strings with a common beginning are neighbours, so for every
place of the anchor in a window equal windows have equal classes on both sides.
Matches are compared byte by byte; should bytes differ, the anchor's windows are
compared directly. One suffix sort takes up to CONTEXTS contexts of an anchor; the
windows of a more crowded one are dealt by window hash, so no anchor's contexts
meet in one task.

Verification. What runs and window hashes call equal is compared too: repeated
runs that follow each other join to stretches, the first occurrence's bytes give a
128-bit digest, and a stretch is removed only if its own bytes have that digest.

All entries travel as packed arrays, a row per task and slice; the number of slices grows with the input.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ocellus.llm.common import _powers, dealt, drop, mix, ordered_rows, slices_of, tidy, unzipped, written, zipped
from ocellus.llm.linking import restrict

#: Contexts of one anchor that a suffix sort takes; more are dealt by window.
CONTEXTS = 4096
FLUSH = 600_000  # runs that a task holds before it deals them out
#: Entries of one anchor that may meet in a slice: a task with more than its share of them deals them by run.
ANCHOR_ENTRIES = 1_000_000
#: First occurrences of one document whose digests are asked for in one row.
ASKED = 4096
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95))
_FIRST = -(1 << 63)
#: In place of a first occurrence's start: the stretch has been compared byte by byte.
COMPARED = np.uint32(0xFFFFFFFF)


class Prefix:
    """Prefix polynomial hashes of a byte array: the hash of any stretch by one subtraction.

    Hashes are taken block by block (each block overlaps the next by ``reach``
    bytes), so the tables of powers stay small for texts of any length.
    """

    def __init__(self, reach: int, block: int = 1 << 16, bases: int = 2):
        self.reach, self.block = reach, block
        n = block + reach + 1
        self.pow = [_powers(n, b) for b in _BASES[:bases]]
        self.inv = [_powers(n, np.uint64(pow(int(b), -1, 1 << 64))) for b in _BASES[:bases]]

    def table(self, body: np.ndarray, which: int = 0) -> np.ndarray:
        out = np.zeros(len(body) + 1, dtype=np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum((body.astype(np.uint64) + np.uint64(1)) * self.pow[which][: len(body)], out=out[1:])
        return out

    def stretch(self, table: np.ndarray, start, end, which: int = 0):
        with np.errstate(over="ignore"):
            return mix((table[end] - table[start]) * self.inv[which][start])


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    step = 1
    while step * 2 <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    rest = width - step
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def runs_of(body: np.ndarray, span: int, prefix: Prefix) -> tuple[np.ndarray, ...]:
    """(anchor hash, run hash, first start, last start, anchor offset from the first start) of the runs of a text."""
    gram = span // 2
    cols: list[list[np.ndarray]] = [[] for _ in range(5)]
    for lo in range(0, max(0, len(body) - span + 1), prefix.block):
        part = body[lo : lo + prefix.block + span - 1]
        table = prefix.table(part)
        at = np.arange(len(part) - gram + 1)
        grams = prefix.stretch(table, at, at + gram)
        width = span - gram + 1
        least = _sliding_min(grams, width)
        # windows that follow each other and share the anchor's value; equal values in one window are told apart by the last place
        place = _last_place(grams, least, width)
        cut = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        end = np.concatenate((cut[1:], [len(place)])) - 1
        anchor = place[cut]
        with np.errstate(over="ignore"):
            run = mix(prefix.stretch(table, cut, end + span) + np.uint64(1 << 16) * (end - cut).astype(np.uint64) + (anchor - cut).astype(np.uint64))
        for c, x in zip(cols, (least[cut], run, cut + lo, end + lo, anchor - cut)):
            c.append(x)
    if not cols[0]:
        return (np.zeros(0, np.uint64), np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
    return tuple(np.concatenate(c) for c in cols)


def _last_place(grams: np.ndarray, least: np.ndarray, width: int) -> np.ndarray:
    """For each window the last place of its least gram."""
    n = len(least)
    cut = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    end = np.concatenate((cut[1:], [n]))
    out = np.empty(n, dtype=np.int64)
    # the least value of a stretch of windows stands at a place inside the stretch's first window
    order = np.argsort(grams, kind="stable")
    ranked = grams[order]
    twice = ranked[1:] == ranked[:-1]
    if not twice.any():  # each value once: its place is unique
        where = order[np.searchsorted(ranked, least[cut])]
        return np.repeat(where, end - cut)
    # with repeats, windows are looked at one by one: the last place <= start + width - 1 of the value
    key = np.searchsorted(ranked, least, side="left")
    stop = np.searchsorted(ranked, least, side="right")
    limit = np.arange(n) + width - 1
    lo, hi = key.copy(), stop.copy()
    while True:  # binary search within each value's places, which ascend
        more = hi - lo > 1
        if not more.any():
            break
        mid = (lo + hi) // 2
        go = more & (order[np.minimum(mid, len(order) - 1)] <= limit)
        lo = np.where(go, mid, lo)
        hi = np.where(more & ~go, mid, hi)
    out[:] = order[lo]
    return out


# --- packed entries --------------------------------------------------------------

#: Kinds of packed entries, with their fields. The first of RUN's states: 0 undecided, 1 of a crowded anchor, 2 a mark of one.
RUN, REPEAT, OPEN, CROWDED, CONTEXT, WINDOW = range(6)
_RUN_FIELDS = {"h": "<u8", "r": "<u8", "rid": "<i8", "start": "<u4", "more": "<u2", "anchor": "<u2", "state": "<u1"}
_FIELDS = {
    RUN: _RUN_FIELDS,
    REPEAT: {"rid": "<i8", "start": "<u4", "more": "<u4", "src": "<i8", "at": "<u4"},
    OPEN: {"h": "<u8", "rid": "<i8", "start": "<u4", "more": "<u2", "anchor": "<u2"},
    CROWDED: {"h": "<u8", "rid": "<i8", "start": "<u4", "more": "<u2", "anchor": "<u2"},
    CONTEXT: {"h": "<u8", "rid": "<i8", "start": "<u4", "anchor": "<u2", "size": "<u2"},
    WINDOW: {"h": "<u8", "r": "<u8", "rid": "<i8", "start": "<u4"},
}
_PACKED = "slice int, kind int, n long, entries binary, bytes binary"


def _pack(kind: int, cols: dict[str, np.ndarray], pick: np.ndarray) -> bytes:
    parts = []
    for k, t in _FIELDS[kind].items():
        x = cols[k][pick].astype(t)
        with np.errstate(over="ignore"):
            parts.append(np.diff(x, prepend=x[:1] * 0) if k == "rid" else x)  # ids in order compress well as differences
    return zipped(*parts)


def _unpack(kind: int, n: int, blob: bytes) -> dict[str, np.ndarray]:
    fields = _FIELDS[kind]
    out = dict(zip(fields, unzipped(blob, n, *fields.values())))
    with np.errstate(over="ignore"):
        out["rid"] = np.cumsum(out["rid"])
    return out


def _gathered(table: pa.Table, kind: int) -> dict[str, np.ndarray]:
    """All entries of one kind in a group of packed rows."""
    kinds, sizes, blobs = (table.column(c).to_pylist() for c in ("kind", "n", "entries"))
    parts = [_unpack(kind, n, b) for k, n, b in zip(kinds, sizes, blobs) if k == kind]
    return {f: np.concatenate([p[f] for p in parts]) if parts else np.zeros(0, t) for f, t in _FIELDS[kind].items()}


class Rows:
    """Packed rows in the making."""

    def __init__(self, slices: int):
        self.slices, self.rows = slices, []

    def deal(self, kind: int, cols: dict[str, np.ndarray], where: np.ndarray, first: int = 0) -> None:
        """Entries by slice; ``first`` is the number of the kind's first slice."""
        order = np.lexsort((cols["start"], cols["rid"]))
        for k, part in dealt(where[order], self.slices):
            part = order[part]
            self.rows.append((first + k, kind, len(part), _pack(kind, cols, part), None))

    def by_document(self, kind: int, cols: dict[str, np.ndarray], first: int = 0) -> None:
        if len(cols["rid"]):
            self.deal(kind, cols, (mix(cols["rid"].astype(np.int64).view(np.uint64)) % np.uint64(self.slices)).astype(np.int64), first)

    def batch(self) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
        out = pa.RecordBatch.from_arrays([pa.array([r[i] for r in self.rows], t) for i, t in enumerate(kinds)], ["slice", "kind", "n", "entries", "bytes"])
        self.rows = []
        return out

    def table(self) -> pa.Table:
        return pa.Table.from_batches([self.batch()])


def _firsts(h: np.ndarray, r: np.ndarray, rid: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by (h, r, rid, start), and for each place in that order the place of the first entry with its (h, r)."""
    order = np.lexsort((start, rid, r, h))
    a, b = h[order], r[order]
    first = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))[: len(order)]
    return order, np.flatnonzero(first)[np.cumsum(first) - 1] if len(order) else order


def _joined(rid, start, more, src, at) -> dict[str, np.ndarray]:
    """Repeats in order of (rid, start); those that follow each other as their first occurrences do are one."""
    order = np.lexsort((start, rid))
    rid, start, more, src, at = (np.asarray(x)[order].astype(np.int64) for x in (rid, start, more, src, at))
    head = np.ones(len(rid), bool)
    head[1:] = (rid[1:] != rid[:-1]) | (src[1:] != src[:-1]) | (start[1:] != start[:-1] + more[:-1] + 1) | (at[1:] - start[1:] != at[:-1] - start[:-1])
    lo = np.flatnonzero(head)
    hi = np.append(lo[1:], len(rid)) - 1 if len(lo) else lo
    return {"rid": rid[lo], "start": start[lo], "more": start[hi] + more[hi] - start[lo], "src": src[lo], "at": at[lo]}


def _repeats(cols: dict[str, np.ndarray], order: np.ndarray, head: np.ndarray) -> dict[str, np.ndarray]:
    """Entries that are not the first of their kind, joined."""
    later = np.flatnonzero(head != np.arange(len(head)))
    mine, theirs = order[later], order[head[later]]
    more = cols["more"][mine] if "more" in cols else np.zeros(len(mine), np.int64)
    return _joined(cols["rid"][mine], cols["start"][mine], more, cols["rid"][theirs], cols["start"][theirs])


# --- runs ------------------------------------------------------------------------


def _deal_runs(slices: int, span: int, share: int):
    """Runs of a task's texts, packed per slice of the anchor hash; repeats within the task are settled here.

    Of an anchor with more than ``share`` runs in the task the runs are dealt by
    their own hash as crowded, and a mark tells the anchor's slice.
    """

    def deal(batches):
        prefix = Prefix(span)
        held: list[tuple] = []
        count = 0

        def flush():
            nonlocal held, count
            names = ("h", "r", "rid", "start", "last", "anchor")
            cols = {k: np.concatenate(c) for k, c in zip(names, zip(*held))}
            held, count = [], 0
            cols["more"] = cols.pop("last") - cols["start"]
            out = Rows(slices)
            order, head = _firsts(cols["h"], cols["r"], cols["rid"], cols["start"])
            out.by_document(REPEAT, _repeats(cols, order, head), slices)
            kept = order[head == np.arange(len(head))]
            cols = {k: c[kept] for k, c in cols.items()}
            h = cols["h"]
            group = np.cumsum(np.concatenate(([True], h[1:] != h[:-1]))) - 1
            crowded = np.bincount(group)[group] > share
            marks = np.flatnonzero(crowded & np.concatenate(([True], h[1:] != h[:-1])))
            cols = {k: np.concatenate((c, c[marks])) for k, c in cols.items()}
            cols["state"] = np.concatenate((crowded.astype(np.uint8), np.full(len(marks), 2, np.uint8)))
            where = np.where(cols["state"] == 1, mix(cols["r"]), cols["h"]) % np.uint64(slices)
            out.deal(RUN, cols, where.astype(np.int64))
            return out.batch()

        for b in batches:
            for rid, text in zip(b.column("rid").to_pylist(), b.column("text")):
                body = np.frombuffer(text.as_buffer(), dtype=np.uint8) if text.as_py() else np.zeros(0, np.uint8)
                h, r, start, last, anchor = runs_of(body, span, prefix)
                if len(h):
                    held.append((h, r, np.full(len(h), rid, np.int64), start, last, anchor))
                    count += len(h)
                    if count >= FLUSH:
                        yield flush()
        if held:
            yield flush()

    return tidy(deal)


def _settle_runs(slices: int, contexts: int):
    """Of a slice: repeated runs, and the runs of open and of crowded anchors, packed by document."""

    def settle(table: pa.Table) -> pa.Table:
        number = table.column("slice")[0].as_py()
        if number >= slices:  # settled already
            return table.set_column(0, "slice", pa.array([number - slices] * table.num_rows, pa.int32()))
        out = Rows(slices)
        cols = _gathered(table, RUN)
        pick = lambda some: {k: c[some] for k, c in cols.items()}
        marked = np.unique(cols["h"][cols["state"] == 2])
        out.by_document(CROWDED, pick(cols["state"] == 1))
        cols = pick(cols["state"] == 0)
        order, head = _firsts(cols["h"], cols["r"], cols["rid"], cols["start"])
        out.by_document(REPEAT, _repeats(cols, order, head))
        cols = pick(order[head == np.arange(len(head))])
        h = cols["h"]
        group = np.cumsum(np.concatenate(([True], h[1:] != h[:-1]))[: len(h)]) - 1
        n = np.bincount(group, minlength=1)[group]
        crowded = (n > contexts) | np.isin(h, marked)
        out.by_document(CROWDED, pick(crowded))
        out.by_document(OPEN, pick(~crowded & (n > 1)))
        return out.table()

    return tidy(settle)


_SPAN = pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("src", pa.int64()), ("at", pa.int64())])
_PLACE = pa.struct([("h", pa.int64()), ("start", pa.int64()), ("last", pa.int64()), ("anchor", pa.int64())])
_FOUND = "rid long, spans array<struct<start:long,stop:long,src:long,at:long>>, open array<struct<h:long,start:long,last:long,anchor:long>>, crowded array<struct<h:long,start:long,last:long,anchor:long>>"


def _by_document(span: int):
    """A row per document of a slice: its repeated stretches, and its runs of open and of crowded anchors."""

    def gather(table: pa.Table) -> pa.Table:
        repeats = _joined(*_gathered(table, REPEAT).values())
        parts = [(repeats["rid"], [repeats["start"], repeats["start"] + repeats["more"] + span, repeats["src"], repeats["at"]], _SPAN)]
        for kind in (OPEN, CROWDED):
            c = _gathered(table, kind)
            order = np.lexsort((c["start"], c["rid"]))
            c = {k: x[order] for k, x in c.items()}
            start = c["start"].astype(np.int64)
            parts.append((c["rid"], [c["h"].view(np.int64), start, start + c["more"], c["anchor"].astype(np.int64)], _PLACE))
        rids = np.unique(np.concatenate([p[0] for p in parts]))
        columns = [pa.array(rids)]
        for rid, fields, kind in parts:
            at = np.searchsorted(rid, np.append(rids, 0))
            at[-1] = len(rid)
            columns.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays([pa.array(f, pa.int64()) for f in fields], fields=list(kind))))
        return pa.table(columns, names=["rid", "spans", "open", "crowded"])

    return tidy(gather)


# --- suffixes --------------------------------------------------------------------


def extension(prefix: Prefix, table: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common extension of the places a and b, up to ``most``."""
    lo, hi = np.zeros(len(a), np.int64), most.astype(np.int64)
    while True:  # a common extension of length lo is known; none of length hi + 1
        more = lo < hi
        if not more.any():
            return lo
        mid = (lo + hi + 1) // 2
        same = prefix.stretch(table, a, a + mid) == prefix.stretch(table, b, b + mid)
        lo = np.where(more & same, mid, lo)
        hi = np.where(more & ~same, mid - 1, hi)


def suffix_order(prefix: Prefix, table: np.ndarray, body: np.ndarray, group: np.ndarray, at: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Order of the suffixes at ``at`` (``right`` bytes long) by (group, bytes): a mergesort by hash-compared extensions.

    Groups are contiguous. Runs of equal length are merged level by level for all
    groups at once: a suffix's place in the merge is its own rank plus its rank in
    the sister run, found by binary search.
    """
    n = len(at)
    order = np.arange(n)
    if not n:
        return order
    start = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    size = np.diff(np.concatenate((start, [n])))
    base, size = np.repeat(start, size), np.repeat(size, size)
    here = np.arange(n) - base  # place within the group
    width = 1

    def before(x: np.ndarray, y: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        most = np.minimum(right[x], right[y])
        e = extension(prefix, table, at[x], at[y], most)
        ended = e >= most
        cx, cy = body[np.minimum(at[x] + e, len(body) - 1)], body[np.minimum(at[y] + e, len(body) - 1)]
        shorter = (right[x] < right[y]) | ((right[x] == right[y]) & or_equal)
        return np.where(ended, shorter, cx < cy)

    while width < size.max():
        run = here // width
        odd = run % 2 == 1
        sister_lo = np.where(odd, run - 1, run + 1) * width
        sister_hi = np.minimum(sister_lo + width, size)
        sister_lo = np.minimum(sister_lo, size)
        lo, hi = sister_lo.copy(), np.maximum(sister_hi, sister_lo)
        while True:
            todo = np.flatnonzero(lo < hi)
            if not len(todo):
                break
            mid = (lo[todo] + hi[todo]) // 2
            other, own = order[base[todo] + mid], order[todo]
            goes = before(other, own, odd[todo])  # equal suffixes of the left run stay ahead
            lo[todo] = np.where(goes, mid + 1, lo[todo])
            hi[todo] = np.where(goes, hi[todo], mid)
        rank = (here - run * width) + (lo - sister_lo) + (run // 2) * 2 * width
        merged = np.empty_like(order)
        merged[base + rank] = order
        order = merged
        width *= 2
    return order


def repeats_by_suffix(h, rid, start, anchor, sizes, body: np.ndarray, span: int) -> dict[str, np.ndarray]:
    """Repeats (compared byte by byte) among contexts: stretches covered by windows that an earlier context of the same anchor has.

    ``body`` holds the contexts one after the other, each from ``start`` to the
    end of the run's last window; contexts stand in order of (h, rid, start).
    """
    n, gram = len(h), span // 2
    nothing = np.zeros(0, np.int64)
    if n < 2:
        return _joined(*[nothing] * 5)
    anchor, sizes = anchor.astype(np.int64), sizes.astype(np.int64)
    at = np.concatenate(([0], np.cumsum(sizes)))[:-1] + anchor
    reach = {"right": sizes - anchor, "left": anchor}
    prefix = Prefix(span, len(body) + 2, bases=1)
    order, common = {}, {}
    for side, text, place in (("right", body, at), ("left", body[::-1].copy(), len(body) - at)):
        table = prefix.table(text)
        rank = order[side] = suffix_order(prefix, table, text, h, place, reach[side])
        x, y = rank[:-1], rank[1:]
        common[side] = np.where(h[x] == h[y], extension(prefix, table, place[x], place[y], np.minimum(reach[side][x], reach[side][y])), -1)

    def classes(side: str, length: int) -> np.ndarray:
        """Numbers that contexts of one anchor share if they agree in ``length`` bytes."""
        out = np.empty(n, np.int64)
        out[order[side]] = np.concatenate(([0], np.cumsum(common[side] < length)))
        return out

    least, most = np.full(n, span), np.full(n, -1)  # how far left of the anchor repeated windows begin
    windows = np.lib.stride_tricks.sliding_window_view(body, span)
    for p in range(span - gram + 1):
        fit = np.flatnonzero((reach["left"] >= p) & (reach["right"] >= span - p))
        if len(fit) < 2:
            continue
        key = classes("right", span - p)[fit] * n + classes("left", p)[fit]
        _, first, back = np.unique(key, return_index=True, return_inverse=True)
        theirs = fit[first[back]]  # contexts stand in order, so the first is the earliest
        later = np.flatnonzero(theirs != fit)
        for lo in range(0, len(later), 1 << 16):
            i, j = fit[later[lo : lo + (1 << 16)]], theirs[later[lo : lo + (1 << 16)]]
            if not (windows[at[i] - p] == windows[at[j] - p]).all():
                return _by_bytes(h, rid, start, anchor, sizes, body, span)
        i = fit[later]
        least[i], most[i] = np.minimum(least[i], p), np.maximum(most[i], p)
    hit = np.flatnonzero(most >= 0)
    begin = start[hit].astype(np.int64) + anchor[hit] - most[hit]
    return _joined(rid[hit], begin, most[hit] - least[hit], rid[hit], np.full(len(hit), COMPARED))


def _by_bytes(h, rid, start, anchor, sizes, body: np.ndarray, span: int) -> dict[str, np.ndarray]:
    """As ``repeats_by_suffix``, by the windows themselves: for contexts of which two different strings had one hash."""
    seen: set[tuple] = set()
    found = []
    at = np.concatenate(([0], np.cumsum(sizes)))
    for i in range(len(h)):
        text = body[at[i] : at[i + 1]].tobytes()
        own = []
        for k in range(len(text) - span + 1):
            key = (int(h[i]), int(anchor[i]) - k, text[k : k + span])
            if key in seen:
                own.append(k)
            else:
                seen.add(key)
        if own:
            found.append((i, own[0], own[-1]))
    i, a, b = (np.array(x, np.int64) for x in zip(*found)) if found else [np.zeros(0, np.int64)] * 3
    return _joined(rid[i], start[i].astype(np.int64) + a, b - a, rid[i], np.full(len(i), COMPARED))


def _lists(column: pa.Array, *fields: str) -> tuple[np.ndarray, list[np.ndarray]]:
    at = column.offsets.to_numpy()
    values = column.values
    return at, [np.asarray(values.field(f)) for f in fields]


def _deal_contexts(slices: int, span: int):
    """From (rid, text, open, crowded): the bytes of open runs by anchor, and the hashes of crowded anchors' windows by window."""

    def deal(batches):
        prefix = Prefix(span)
        contexts: list[tuple] = []
        texts: list[bytes] = []
        windows: list[tuple] = []
        size = 0

        def flush():
            nonlocal contexts, texts, windows, size
            out = Rows(slices)
            if contexts:
                cols = {k: np.concatenate(c) for k, c in zip(("h", "rid", "start", "anchor", "size"), zip(*contexts))}
                order = np.lexsort((cols["start"], cols["rid"]))
                for k, part in dealt((cols["h"][order] % np.uint64(slices)).astype(np.int64), slices):
                    part = order[part]
                    body = pa.compress(b"".join([texts[i] for i in part]), codec="zstd", asbytes=True)
                    out.rows.append((k, CONTEXT, len(part), _pack(CONTEXT, cols, part), body))
            if windows:
                cols = {k: np.concatenate(c) for k, c in zip(("h", "r", "rid", "start"), zip(*windows))}
                order, head = _firsts(*cols.values())
                out.by_document(REPEAT, _repeats(cols, order, head), 2 * slices)
                kept = order[head == np.arange(len(head))]
                cols = {k: c[kept] for k, c in cols.items()}
                out.deal(WINDOW, cols, (cols["h"] % np.uint64(slices)).astype(np.int64), slices)
            contexts, texts, windows, size = [], [], [], 0
            return out.batch()

        def hashed(bodies: list[bytes], rids, starts):
            """Both hashes of all windows of some stretches that together fit a block."""
            sizes = np.array([len(x) for x in bodies])
            first = np.concatenate(([0], np.cumsum(sizes)))[:-1]
            n = sizes - span + 1
            off = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at = np.repeat(first, n) + off
            part = np.frombuffer(b"".join(bodies), np.uint8)
            one, two = (prefix.stretch(prefix.table(part, k), at, at + span, k) for k in (0, 1))
            windows.append((one, two, np.repeat(np.array(rids, np.int64), n), np.repeat(np.array(starts, np.int64), n) + off))
            return len(at)

        for b in batches:
            open_at, (h, start, last, anchor) = _lists(b.column("open"), "h", "start", "last", "anchor")
            many_at, (_, from_, to, _) = _lists(b.column("crowded"), "h", "start", "last", "anchor")
            waiting: tuple[list, list, list] = ([], [], [])
            held = 0
            for k, (rid, text) in enumerate(zip(b.column("rid").to_pylist(), b.column("text"))):
                body = text.as_py()
                lo, hi = open_at[k], open_at[k + 1]
                if hi > lo:
                    stop = last[lo:hi] + span
                    texts += [body[i:j] for i, j in zip(start[lo:hi].tolist(), stop.tolist())]
                    contexts.append((h[lo:hi].view(np.uint64), np.full(hi - lo, rid, np.int64), start[lo:hi], anchor[lo:hi], stop - start[lo:hi]))
                    size += int((stop - start[lo:hi]).sum())
                for i, j in zip(from_[many_at[k] : many_at[k + 1]].tolist(), to[many_at[k] : many_at[k + 1]].tolist()):
                    if held + j + span - i > prefix.block:
                        size += 40 * hashed(*waiting)
                        waiting, held = ([], [], []), 0
                    for x, y in zip(waiting, (body[i : j + span], rid, i)):
                        x.append(y)
                    held += j + span - i
                if size > 48 << 20:
                    yield flush()
            if held:
                size += 40 * hashed(*waiting)
        if size:
            yield flush()

    return tidy(deal)


def _settle_contexts(slices: int, span: int):
    """Of a slice of contexts or of windows: repeats, packed by document."""

    def settle(table: pa.Table) -> pa.Table:
        number = table.column("slice")[0].as_py()
        if number >= 2 * slices:  # settled already
            return table.set_column(0, "slice", pa.array([number - 2 * slices] * table.num_rows, pa.int32()))
        out = Rows(slices)
        if number >= slices:
            cols = _gathered(table, WINDOW)
            out.by_document(REPEAT, _repeats(cols, *_firsts(*cols.values())))
            return out.table()
        cols = _gathered(table, CONTEXT)
        sizes = cols["size"].astype(np.int64)
        bodies, at = [], 0
        for n, x in zip(table.column("n").to_pylist(), table.column("bytes").to_pylist()):
            bodies.append(pa.decompress(x, decompressed_size=int(sizes[at : at + n].sum()), codec="zstd", asbytes=True))
            at += n
        body = np.frombuffer(b"".join(bodies), np.uint8)
        first = np.concatenate(([0], np.cumsum(sizes)))[:-1]
        order = np.lexsort((cols["start"], cols["rid"], cols["h"]))
        moved = np.repeat(first[order], sizes[order]) + np.arange(len(body)) - np.repeat(np.cumsum(sizes[order]) - sizes[order], sizes[order])
        cols = {k: c[order] for k, c in cols.items()}
        out.by_document(REPEAT, repeats_by_suffix(cols["h"], cols["rid"], cols["start"], cols["anchor"], cols["size"], body[moved], span))
        return out.table()

    return tidy(settle)


# --- documents -------------------------------------------------------------------


def _digest(body: bytes) -> bytes:
    return hashlib.blake2b(body, digest_size=16).digest()


def _digests(batches):
    """From (rid, text, asked): the digest of each stretch that is asked for."""
    for b in batches:
        at, (start, size) = _lists(b.column("asked"), "at", "size")
        rows = []
        for k, (rid, text) in enumerate(zip(b.column("rid").to_pylist(), b.column("text"))):
            body = text.as_py()
            rows += [(rid, i, n, _digest(body[i : i + n])) for i, n in zip(start[at[k] : at[k + 1]].tolist(), size[at[k] : at[k + 1]].tolist())]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["src", "at", "size", "digest"])


def _keep(span: int):
    """From (doc_id, text, copy, removed stretches): what is left of each text."""

    def kept(batches):
        for b in batches:
            size, gone, spans, sha, rest = [], [], [], [], []
            for text, copy, cuts in zip(b.column("text"), b.column("copy").to_pylist(), b.column("cuts").to_pylist()):
                body = text.as_py()
                left, n, stop = [], 0, -1
                found = [(c["start"], c["stop"], c["digest"]) for c in cuts or ()] if copy == 1 else [(0, len(body), b"")] * (len(body) >= span)
                for start, end, digest in sorted(found, key=lambda c: c[:2]):
                    if digest != b"" and digest != _digest(body[start:end]):
                        raise ArithmeticError("two different strings had one hash; the job stops rather than remove one of them")
                    if start > stop:
                        n += 1
                        left.append(body[max(stop, 0) : start])
                    stop = max(stop, end)
                left.append(body[max(stop, 0) :])
                whole = b"".join(left)
                size.append(len(body))
                gone.append(len(body) - len(whole))
                spans.append(n)
                sha.append(hashlib.sha256(whole).hexdigest())
                rest.append(whole)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *[pa.array(x, pa.int64()) for x in (size, gone, spans)], pa.array(sha), pa.array(rest, pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    return tidy(kept)


def repeated_strings(docs: DataFrame, span: int = 100, contexts: int = CONTEXTS) -> DataFrame:
    """(rid, cuts) of docs(rid, text): stretches (start, stop, digest) of bytes covered by ``span``-byte strings that start earlier.

    Earlier: in a row of smaller rid, or in the same row. ``digest`` is that of the
    first occurrence, empty for stretches compared byte by byte already.
    """
    slices = slices_of(docs)
    tasks = max(1, docs.rdd.getNumPartitions())
    runs = docs.mapInArrow(_deal_runs(slices, span, max(1, ANCHOR_ENTRIES // tasks)), _PACKED)
    by_document = lambda packed: written(packed.groupBy("slice").applyInArrow(_by_document(span), _FOUND))
    first = by_document(runs.groupBy("slice").applyInArrow(_settle_runs(slices, contexts), _PACKED))
    unsettled = first.filter(F.size("open") + F.size("crowded") > 0).select("rid", "open", "crowded")
    around = restrict(docs, unsettled.select("rid"), "rid").join(unsettled, "rid").select("rid", "text", "open", "crowded")
    again = around.mapInArrow(_deal_contexts(slices, span), _PACKED).groupBy("slice").applyInArrow(_settle_contexts(slices, span), _PACKED)
    second = by_document(again)
    found = first.select("rid", F.explode("spans").alias("s")).unionByName(second.select("rid", F.explode("spans").alias("s"))).select(
        "rid", "s.start", "s.stop", "s.src", "s.at", (F.col("s.stop") - F.col("s.start")).alias("size"))
    asked = written(found.filter(F.col("at") != int(COMPARED)).select("src", "at", "size").distinct())
    parts = asked.groupBy("src").agg(F.ceil(F.count("*") / ASKED).alias("parts"))
    asked_of = (
        asked.join(parts, "src").groupBy(F.col("src").alias("rid"), F.pmod(F.xxhash64("at", "size"), F.col("parts")).alias("part"))
        .agg(F.collect_list(F.struct("at", "size")).alias("asked"))
    )
    sources = restrict(docs, parts.select(F.col("src").alias("rid")), "rid")
    digests = written(sources.join(asked_of, "rid").select("rid", "text", "asked").mapInArrow(_digests, "src long, at long, size long, digest binary"))
    known = found.join(digests, ["src", "at", "size"], "left")
    digest = F.when(F.col("at") == int(COMPARED), F.lit(b"")).otherwise(F.col("digest"))
    cuts = written(known.groupBy("rid").agg(F.collect_list(F.struct("start", "stop", digest.alias("digest"))).alias("cuts")))
    drop(first, second, asked, digests)
    return cuts


def remove_repeats(df: DataFrame, span: int = 100, id_col: str = "doc_id", text_col: str = "text", contexts: int = CONTEXTS) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes left).

    Each row is a document of its own. Rows stand in order of id, a null id
    first; rows of one id in order of their text's SHA-256; of rows with one id
    and text the first stays and the others lose all bytes that a string covers. A null or
    empty text, or one shorter than ``span``, loses nothing. An empty table gives
    no rows. Other columns are not read. Memory follows the longest text.
    """
    docs, _ = ordered_rows(df, _FIRST, id_col, text_col)
    docs = docs.withColumn("text", F.encode("text", "UTF-8"))
    cuts = repeated_strings(docs.filter("copy = 1").select("rid", "text"), span, contexts)
    both = docs.join(cuts, "rid", "left").select("doc_id", "text", "copy", "cuts")
    return both.mapInArrow(_keep(span), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
