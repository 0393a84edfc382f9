"""Outlines of labelled pixels as checked polygon parts, and their GeoJSON features."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ocellus.operators.components import union_find
from ocellus.operators.geometry import simplified
from ocellus.operators.grouped import box_pairs, flat_lists, within
from ocellus.operators.painting import BOX, visible_objects

# Smoothing, the limits of the simplification in pixels, and the margin around an object
SIGMA, LOOSE, TIGHTEST, LOOSEST, MARGIN = 0.5, 0.002, 0.5, 2.0, 2
# Why a ring that meets itself is not exported
TOUCHES = "self-intersecting or self-touching contour"
# The eight neighbours, clockwise from the east (rows run downwards)
AROUND = ((1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1))
# The first set neighbour from a direction on, by the bits of a pixel's neighbours; 8 without any
NEXT = np.array([[next((d % 8 for d in range(f, f + 8) if code >> (d % 8) & 1), 8) for code in range(256)] for f in range(8)])
# Ends of an image of unknown size
HUGE = 1 << 60


def kernel_of(sigma: float) -> np.ndarray:
    reach = int(4 * sigma + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return kernel / kernel.sum()


# The kernel, and its sum over every pattern of five pixels in a column, added up in the order of ``smoothed``
KERNEL = kernel_of(SIGMA)
SOFT = sum(k * (np.arange(32) >> i & 1) for i, k in enumerate(KERNEL))


def smoothed(mask: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """The mask where a Gaussian blur of it, cut at four sigma, exceeds one half; masks of five pixels or fewer a side stay."""
    if min(mask.shape) <= 5:
        return mask
    kernel = kernel_of(sigma)
    reach = len(kernel) // 2
    wide = np.pad(mask.astype(float), reach, mode="edge")
    wide = sum(k * wide[i : i + mask.shape[0]] for i, k in enumerate(kernel))
    return sum(k * wide[:, i : i + mask.shape[1]] for i, k in enumerate(kernel)) > 0.5


def labelled_runs(mask: np.ndarray, corners: bool) -> list[tuple[int, int, int, int]]:
    """(row, c0, c1, component) of a mask's runs; objects hang together by sides, and by corners if so asked."""
    step = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    rows, c0 = np.nonzero(step == 1)
    c1 = np.nonzero(step == -1)[1]
    by_row: dict[int, list[int]] = {}
    for i, r in enumerate(rows.tolist()):
        by_row.setdefault(r, []).append(i)
    edges = [(i, j) for r, here in by_row.items() for i in here for j in by_row.get(r + 1, ()) if c0[i] < c1[j] + corners and c0[j] < c1[i] + corners]
    group = union_find([e[0] for e in edges], [e[1] for e in edges])
    return [(r, a, b, group.get(i, i)) for i, (r, a, b) in enumerate(zip(rows.tolist(), c0.tolist(), c1.tolist()))]


def walk(pixels: bytes, width: int, at: int) -> list[int]:
    """Directions of the steps around an object, from its first pixel back to it; ``pixels`` are rows of ``width`` with an empty frame."""
    ways = [dx + dy * width for dx, dy in AROUND] * 2
    start, first, begin = at, 5, None
    steps: list[int] = []
    while True:
        d = next((d for d in range(first, first + 8) if pixels[at + ways[d]]), None)
        if d is None:
            return steps
        d %= 8
        if at == start and d == begin:
            return steps
        begin = d if begin is None else begin
        steps.append(d)
        at += ways[d]
        first = (d + (6 if d % 2 else 7)) % 8  # the next neighbour after the empty one seen last


def borders(mask: np.ndarray) -> list[np.ndarray]:
    """Pixels (x, y) of the outer border of each object that lies in no other's hole, in order along it."""
    padded = np.pad(mask.astype(bool), 1)
    first: dict[int, tuple[int, int]] = {}
    for r, a, _, label in labelled_runs(padded, True):
        first.setdefault(label, (r, a))
    if len(first) > 1:  # one alone lies in no hole
        outside = np.zeros(padded.shape, bool)
        empty = labelled_runs(~padded, False)
        for r, a, b, label in empty:
            if label == empty[0][3]:
                outside[r, a:b] = True
        first = {label: (r, a) for label, (r, a) in first.items() if outside[r - 1, a]}
    pixels, width, out = padded.tobytes(), padded.shape[1], []
    ways = np.array(AROUND, dtype=np.int64)
    for r, a in first.values():
        moves = ways[np.array(walk(pixels, width, r * width + a)[:-1], dtype=np.int64)]
        out.append(np.concatenate(([[a, r]], [[a, r]] + np.cumsum(moves, axis=0))) - 1)
    return out


def area_of(points: np.ndarray) -> float:
    x, y = points[:, 0].astype(float), points[:, 1].astype(float)
    return abs(float(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1)))) / 2


def ring_simplified(points: np.ndarray) -> np.ndarray:
    """The closed line without points nearer than the tolerance to it, cut first at two points far apart."""
    if len(points) < 4:
        return points.astype(float)
    points = points.astype(float)
    length = np.hypot(*(np.roll(points, -1, axis=0) - points).T).sum()
    tolerance = min(max(LOOSE * length, TIGHTEST), LOOSEST)
    far = lambda i: int(np.argmax(np.hypot(*(points - points[i]).T)))
    i = far(0)
    j = far(i)
    turned = np.roll(points, -i, axis=0)
    k = (j - i) % len(points)
    one, two = turned[: k + 1], np.concatenate((turned[k:], turned[:1]))
    return np.concatenate((simplified(one, tolerance)[:-1], simplified(two, tolerance)[:-1]))


def parts_of(rows: np.ndarray, c0: np.ndarray, c1: np.ndarray, height: int | None = None, width: int | None = None, corner: tuple[int, int] | None = None) -> list[tuple[float, np.ndarray]]:
    """(area, ring) of each part of one object from its runs, in the image's coordinates; ``corner`` (x, y) is where its mask begins unless by the margin."""
    left, top = corner or (max(0, int(c0.min()) - MARGIN), max(0, int(rows.min()) - MARGIN))
    bottom, right = int(rows.max()) + 1 + MARGIN, int(c1.max()) + MARGIN
    bottom, right = (bottom if height is None else min(bottom, height)), (right if width is None else min(right, width))
    mask = np.zeros((bottom - top, right - left), bool)
    for r, a, b in zip(rows, c0, c1):
        mask[r - top, a - left : b - left] = True
    return [(area_of(b), ring_simplified(b) + (left, top)) for b in borders(smoothed(mask))]


def outline_parts(runs: DataFrame, sizes: DataFrame | None = None, on: str = "slide_id", key: str = "det_id") -> DataFrame:
    """(on, key, part, part_area, ring, reason) from disjoint runs (on, key, row, c0, c1).

    The pixels of an object are one row of the plan, so nothing larger than an
    object meets in a task. ``sizes`` (on, width, height) clips the margin at the
    image's ends. ``reason`` tells why a part is no valid ring, and is null if it
    is one; an object that smoothing removes has one row, without ring.
    """
    objects = runs.groupBy(on, key).agg(F.collect_list(F.struct("row", "c0", "c1")).alias("runs"))
    return object_parts(objects.select(on, key, F.col("runs.row").alias("row"), F.col("runs.c0").alias("c0"), F.col("runs.c1").alias("c1")), sizes, on, key)


def crosses_itself(ring: np.ndarray, near: float = 1e-9) -> bool:
    """Whether a ring repeats a vertex or two of its edges that are not neighbours share a point: the rule of ``self_touching``."""
    n = len(ring)
    if len({tuple(p) for p in (ring + 0.0).tolist()}) < n:
        return True
    i, j = np.triu_indices(n, 2)
    far = ~((i == 0) & (j == n - 1))
    i, j = i[far], j[far]
    p, d = ring, np.roll(ring, -1, axis=0) - ring
    low, high = np.floor(np.minimum(p, p + d) - near), np.floor(np.maximum(p, p + d) + near) + 1
    meet = ((low[i] < high[j]) & (low[j] < high[i])).all(axis=1)
    i, j = i[meet], j[meet]
    if not len(i):
        return False
    w = p[j] - p[i]
    turn = d[i, 0] * d[j, 1] - d[i, 1] * d[j, 0]
    offset = w[:, 0] * d[i, 1] - w[:, 1] * d[i, 0]
    with np.errstate(divide="ignore", invalid="ignore"):
        along = lambda x, y: (x * d[i, 0] + y * d[i, 1]) / (d[i, 0] * d[i, 0] + d[i, 1] * d[i, 1])
        first, last = along(w[:, 0], w[:, 1]), along(w[:, 0] + d[j, 0], w[:, 1] + d[j, 1])
        share = lambda v: (v >= -near) & (v <= 1 + near)
        crossing = share((w[:, 0] * d[j, 1] - w[:, 1] * d[j, 0]) / turn) & share(offset / turn)
    on_line = (np.abs(offset) <= near) & (np.minimum(first, last) <= 1 + near) & (np.maximum(first, last) >= -near)
    return bool(np.where(np.abs(turn) > near, crossing, on_line).any())


def walks(codes: np.ndarray, stride: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which walks end, their lengths, their pixels) of walks as by ``walk``, all of them a step at a time.

    ``codes`` say which of the eight neighbours of a pixel are set, in rows of ``stride``. A walk that meets a pixel before
    its start, in order of rows, is given up: an outer border begins at its first pixel, and a hole's has pixels above.
    """
    ways = np.stack([dx + dy * stride for dx, dy in AROUND], axis=1)
    who, at, first = np.arange(len(start)), start.copy(), np.full(len(start), 5)
    length, begin = np.ones(len(start), np.int64), np.full(len(start), -1)
    ended, steps = np.zeros(len(start), bool), [(who, at)]
    while len(who):
        d = NEXT[first, codes[at]]
        over = (d == 8) | ((at == start[who]) & (d == begin[who]))
        ended[who[over]] = True
        who, at, d = who[~over], at[~over], d[~over]
        begin[who] = np.where(begin[who] < 0, d, begin[who])
        at = at + ways[who, d]
        fine = at >= start[who]
        who, at, d = who[fine], at[fine], d[fine]
        length[who] += 1
        first = (d + np.where(d % 2, 6, 7)) % 8
        steps.append((who, at))
    length -= ended & (begin >= 0)  # the last step is back at the start
    whole = np.flatnonzero(ended)
    room = np.where(ended, length, 0)
    offset = np.cumsum(room) - room
    pixels = np.empty(int(room.sum()), np.int64)
    for i, (who, at) in enumerate(steps):
        some = room[who] > i
        pixels[offset[who[some]] + i] = at[some]
    return whole, length[whole], pixels


def masks_traced(counts: np.ndarray, row: np.ndarray, c0: np.ndarray, c1: np.ndarray, height: np.ndarray, width: np.ndarray, room: int = 150_000) -> tuple[np.ndarray, ...]:
    """(object, number of pixels, x, y) of ``borders(smoothed(mask))`` of many objects, by object and in its order, and which objects have a border in another's box.

    Runs are relative to the object's box (height, width); masks have the whole margin, and x, y count from its corner.
    """
    edge = MARGIN + 1  # an empty frame beyond the margin
    first = np.cumsum(counts) - counts
    sized = np.lexsort((height, width))
    base, stride = np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
    codes, begun, owner, done, lo = [], [], [], 0, 0
    while lo < len(sized):
        size = lambda hi: int(height[sized[lo:hi]].max() + 2 * edge) * int(width[sized[hi - 1]] + 2 * edge) * (hi - lo)  # noqa: E731, B023
        hi = min(len(sized), lo + 256)
        while hi - lo > 1 and size(hi) > room:
            hi = lo + (hi - lo) // 2
        obj = sized[lo:hi]
        high, wide = int(height[obj].max()) + 2 * edge, int(width[obj[-1]]) + 2 * edge
        n = counts[obj]
        r = np.repeat(first[obj], n) + within(n)
        line = (np.repeat(np.arange(hi - lo), n) * high + row[r] + edge) * wide + edge
        ends = np.zeros((hi - lo) * high * wide, np.int8)
        np.add.at(ends, line + c0[r], 1)
        np.add.at(ends, line + c1[r], -1)
        mask = np.cumsum(ends, dtype=np.int8).view(np.uint8)
        soft = SOFT[_five(mask, wide)]
        blur = KERNEL[0] * soft[:-4]
        for i in range(1, 5):
            blur += KERNEL[i] * soft[i : len(soft) - 4 + i]
        smooth = np.zeros_like(mask)
        smooth[2:-2] = blur > 0.5
        thin = np.minimum(height, width)[obj] + 2 * MARGIN <= 5
        if thin.any():
            smooth.reshape(hi - lo, -1)[thin] = mask.reshape(hi - lo, -1)[thin]
        code = np.zeros_like(mask)
        for d, (dx, dy) in enumerate(AROUND):
            w = dx + dy * wide
            code[max(0, -w) : len(code) - max(0, w)] |= smooth[max(0, w) : len(code) - max(0, -w)] << d
        turn = np.flatnonzero(smooth[1:] != smooth[:-1]) + 1
        start, stop = turn[::2], turn[1::2]
        total = np.concatenate(([0], np.cumsum(smooth, dtype=np.int32)))
        top = start[total[stop + 1 - wide] == total[start - 1 - wide]]  # runs with nothing above them, corners included
        codes.append(code)
        begun.append(top + done)
        owner.append(obj[top // (high * wide)])
        base[obj], stride[obj] = done + np.arange(hi - lo) * high * wide, wide
        done += len(code)
        lo = hi
    codes, begun, owner = np.concatenate(codes), np.concatenate(begun), np.concatenate(owner)
    order = np.lexsort((begun, owner))
    begun, owner = begun[order], owner[order]
    whole, n, at = walks(codes, stride[owner], begun)
    of = owner[whole]
    point = np.repeat(of, n)
    y, x = np.divmod(at - base[point], stride[point])
    x, y = x - 1, y - 1
    nested = np.zeros(len(counts), bool)
    begin = np.cumsum(n) - n
    many = np.flatnonzero(np.bincount(of, minlength=len(counts)) > 1)
    if len(many):
        l, t, e, b = (f.reduceat(v, begin) for f, v in ((np.minimum, x), (np.minimum, y), (np.maximum, x), (np.maximum, y)))
        for o, i, j in zip(many, np.searchsorted(of, many), np.searchsorted(of, many, "right")):
            p = slice(i, j)
            nested[o] = ((l[p] > l[p, None]) & (t[p] > t[p, None]) & (e[p] < e[p, None]) & (b[p] < b[p, None])).any()
    return of, n, x, y, nested


def _five(mask: np.ndarray, wide: int) -> np.ndarray:
    """Five bits a pixel: the mask two rows above to two rows below it; flat rows of ``wide``, empty at both ends."""
    out = np.zeros_like(mask)
    for i in range(5):
        w = (i - 2) * wide
        out[max(0, -w) : len(out) - max(0, w)] |= mask[max(0, w) : len(out) - max(0, -w)] << i
    return out


def first_largest(values: np.ndarray, begin: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The largest value of each stretch from ``begin``, and the first place where it stands; ``of`` numbers the stretch of a value."""
    most = np.maximum.reduceat(values, begin)
    at = np.flatnonzero(values == most[of])
    return most, at[np.concatenate(([True], of[at[1:]] != of[at[:-1]]))]


def rings_simplified(n: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``ring_simplified`` of many rings of n points each, all of them a cut at a time."""
    if not len(n):
        return n, x.astype(float), y.astype(float)
    x, y = x.astype(float), y.astype(float)
    begin, of, place = np.cumsum(n) - n, np.repeat(np.arange(len(n)), n), within(n)
    after = begin[of] + (place + 1) % n[of]
    step = np.hypot(x[after] - x, y[after] - y)
    tolerance = np.full(len(n), TIGHTEST)
    for r in np.flatnonzero(LOOSE * np.add.reduceat(step, begin) > TIGHTEST - 1e-6):
        tolerance[r] = min(max(LOOSE * step[begin[r] : begin[r] + n[r]].sum(), TIGHTEST), LOOSEST)
    far = lambda i: first_largest(np.hypot(x - x[i][of], y - y[i][of]), begin, of)[1]
    few = n < 4
    i = np.where(few, begin, far(begin))
    k = (far(i) - i) % n
    # every ring turned to begin, and closed, at i
    n1 = n + 1
    begin1, of1 = np.cumsum(n1) - n1, np.repeat(np.arange(len(n)), n1)
    place1 = within(n1)
    turned = begin[of1] + (i[of1] - begin[of1] + place1) % n[of1]
    x, y = x[turned], y[turned]
    keep = (place1 == 0) | (place1 == k[of1]) | few[of1]
    s, e = np.concatenate((begin1, begin1 + k))[np.tile(~few, 2)], np.concatenate((begin1 + k, begin1 + n))[np.tile(~few, 2)]
    while True:
        some = e > s + 1
        s, e = s[some], e[some]
        if not len(s):
            break
        m = e - s - 1
        seg, at = np.repeat(np.arange(len(s)), m), np.repeat(s + 1, m) + within(m)
        dx, dy = x[e] - x[s], y[e] - y[s]
        length = np.hypot(dx, dy)
        ax, ay, long_ = x[at] - x[s][seg], y[at] - y[s][seg], length[seg]
        gap = np.abs(dx[seg] * ay - dy[seg] * ax) / np.where(long_ > 0, long_, 1)
        loop = long_ == 0
        gap[loop] = np.hypot(ax[loop], ay[loop])
        most, best = first_largest(gap, np.cumsum(m) - m, seg)
        cut = most > tolerance[of1[s]]
        middle = at[best][cut]
        keep[middle] = True
        s, e = np.concatenate((s[cut], middle)), np.concatenate((middle, e[cut]))
    keep &= place1 < n[of1]
    return np.bincount(of1[keep], minlength=len(n)), x[keep], y[keep]


def ring_faults(n: np.ndarray, x: np.ndarray, y: np.ndarray, near: float = 1e-9) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unique vertices, area, whether it crosses itself as by ``crosses_itself``) of each of many rings; edges meet by their boxes in order of x."""
    if not len(n):
        return n, n.astype(float), n.astype(bool)
    begin, of, place = np.cumsum(n) - n, np.repeat(np.arange(len(n)), n), within(n)
    order = np.lexsort((y, x, of))
    new = np.concatenate(([True], (of[order][1:] != of[order][:-1]) | (x[order][1:] != x[order][:-1]) | (y[order][1:] != y[order][:-1])))
    corners = np.bincount(of[order][new], minlength=len(n))
    after = begin[of] + (place + 1) % n[of]
    dx, dy = x[after] - x, y[after] - y
    area = np.abs(np.add.reduceat(x * y[after] - x[after] * y, begin)) / 2
    crossed = corners < n
    low, high = lambda p, d: np.floor(np.minimum(p, p + d) - near).astype(np.int64), lambda p, d: (np.floor(np.maximum(p, p + d) + near) + 1).astype(np.int64)
    for a, b in box_pairs(of, low(x, dx), low(y, dy), high(x, dx), high(y, dy)):
        i, j = np.minimum(a, b), np.maximum(a, b)
        far = (j > i + 1) & ~((place[i] == 0) & (place[j] == n[of[j]] - 1))
        i, j = i[far], j[far]
        wx, wy = x[j] - x[i], y[j] - y[i]
        turn, offset = dx[i] * dy[j] - dy[i] * dx[j], wx * dy[i] - wy * dx[i]
        with np.errstate(divide="ignore", invalid="ignore"):
            along = lambda u, v: (u * dx[i] + v * dy[i]) / (dx[i] * dx[i] + dy[i] * dy[i])  # noqa: E731, B023
            first, last = along(wx, wy), along(wx + dx[j], wy + dy[j])
            share = lambda v: (v >= -near) & (v <= 1 + near)
            crossing = share((wx * dy[j] - wy * dx[j]) / turn) & share(offset / turn)
        on_line = (np.abs(offset) <= near) & (np.minimum(first, last) <= 1 + near) & (np.maximum(first, last) >= -near)
        crossed[of[i[np.where(np.abs(turn) > near, crossing, on_line)]]] = True
    return corners, area, crossed


def many_parts(counts: np.ndarray, row: np.ndarray, c0: np.ndarray, c1: np.ndarray, height: np.ndarray, width: np.ndarray, seen: dict | None = None) -> tuple[np.ndarray, ...]:
    """(object, part_area, points, x, y, fault, area of the ring) of the parts of many objects, by object and in the image's coordinates; ``height`` and ``width`` of the image, or a huge number.

    ``seen`` keeps the parts of boxes by their size.
    """
    begin = np.cumsum(counts) - counts
    top, low, left, right = np.minimum.reduceat(row, begin), np.maximum.reduceat(row, begin) + 1, np.minimum.reduceat(c0, begin), np.maximum.reduceat(c1, begin)
    clipped = (top < MARGIN) | (left < MARGIN) | (low + MARGIN > height) | (right + MARGIN > width)
    of = np.repeat(np.arange(len(counts)), counts)
    row, c0, c1 = row - top[of], c0 - left[of], c1 - left[of]
    h, w = low - top, right - left
    # boxes of one size are traced once; every other object for itself
    box = (counts == h) & (np.add.reduceat(c1 - c0, begin) == h * w) & ~clipped
    form = np.where(box, (h << 31) + w, -1 - np.arange(len(counts)))
    lead, to = np.unique(form, return_index=True, return_inverse=True)[1:]
    seen = {} if seen is None else seen
    old = [(u, seen[f]) for u, f in enumerate(form[lead].tolist()) if f in seen]
    known = np.zeros(len(lead), bool)
    known[[u for u, _ in old]] = True
    at = np.flatnonzero(~clipped[lead] & ~known)
    o = lead[at]
    rings: list[tuple] = [(np.array([u for u, _ in old]), *(np.concatenate([r[i] for _, r in old]) for i in range(4)))] if old else []
    apart = clipped[lead].copy()
    if len(o):
        r = np.repeat(begin[o], counts[o]) + within(counts[o])
        who, n, x, y, nested = masks_traced(counts[o], row[r], c0[r], c1[r], h[o], w[o])
        apart[at[nested]] = True
        area = np.zeros(len(n)) if not len(n) else np.abs(_shoelace(n, x, y)) / 2
        m, x, y = rings_simplified(n, x, y)
        rings.append((at[who][~nested[who]], area[~nested[who]], m[~nested[who]], *(v[~np.repeat(nested[who], m)] - MARGIN for v in (x, y))))
        first = np.cumsum(m) - m
        for i in np.flatnonzero(box[o][who]) if len(seen) < 20_000 else ():
            p = slice(first[i], first[i] + m[i])
            seen[int(form[o[who[i]]])] = (area[i : i + 1], m[i : i + 1], x[p] - MARGIN, y[p] - MARGIN)
    for u in np.flatnonzero(apart):  # at the image's ends, or with parts that may lie in a hole
        k = lead[u]
        p = slice(begin[k], begin[k] + counts[k])
        found = parts_of(row[p] + top[k], c0[p] + left[k], c1[p] + left[k], int(height[k]), int(width[k]))
        for area, ring in found:
            rings.append((np.array([u]), np.array([area]), np.array([len(ring)]), ring[:, 0] - left[k], ring[:, 1] - top[k]))
    who, area, n, x, y = (np.concatenate(v) for v in zip(*rings)) if rings else (np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64), np.empty(0), np.empty(0))
    first = np.cumsum(n) - n
    corners, ring_area_, crossed = ring_faults(n, x, y)
    fault = np.where(corners < 3, 1, np.where(ring_area_ <= 1e-6, 2, np.where(crossed, 3, 0)))
    order = np.argsort(who, kind="stable")
    parts = np.bincount(who, minlength=len(lead))
    lo = np.cumsum(parts) - parts
    to = to.ravel()
    obj = np.repeat(np.arange(len(counts)), parts[to])
    ring = order[np.repeat(lo[to], parts[to]) + within(parts[to])]
    p = np.repeat(first[ring], n[ring]) + within(n[ring])
    return obj, area[ring], n[ring], x[p] + np.repeat(left[obj], n[ring]), y[p] + np.repeat(top[obj], n[ring]), fault[ring], ring_area_[ring]


def _shoelace(n: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    begin, of = np.cumsum(n) - n, np.repeat(np.arange(len(n)), n)
    after = begin[of] + (within(n) + 1) % n[of]
    return np.add.reduceat(x * y[after] - x[after] * y, begin)


def traced(on: str, key: str, known: bool) -> tuple[Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], str]:
    """``object_parts`` of batches of objects, and its schema; ``known`` tells whether they have the image's height and width."""
    reasons = pa.array([None, "fewer than 3 unique vertices", "zero-area contour", TOUCHES, "no contours"])

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict = {}
        for b in batches:
            counts, row, c0, c1 = flat_lists(b, ("row", "c0", "c1"))
            if not len(counts):
                continue
            limit = lambda c: pc.fill_null(b.column(c).cast(pa.int64()), HUGE).to_numpy(zero_copy_only=False) if known else np.full(len(counts), HUGE)  # noqa: E731, B023
            obj, area, n, x, y, fault, ring = many_parts(counts, row, c0, c1, limit("height"), limit("width"), seen)
            begin = np.cumsum(counts) - counts
            px = np.add.reduceat(c1 - c0, begin)
            cx, cy = np.add.reduceat((c0 + c1 - 1) * (c1 - c0), begin) / (2.0 * px), np.add.reduceat(row * (c1 - c0), begin) / px
            parts = np.bincount(obj, minlength=len(counts))
            none = np.flatnonzero(parts == 0)
            valid = fault == 0
            count, total = np.bincount(obj[valid], minlength=len(counts)), np.bincount(obj[valid], weights=ring[valid], minlength=len(counts))
            part = within(parts)
            order = np.lexsort((part, -area, ~valid, obj))
            index = np.empty(len(obj), np.int64)
            index[order] = within(parts) + 1
            who = np.concatenate((obj, none))
            fill = lambda v, z: np.concatenate((v, np.full(len(none), z, v.dtype)))  # noqa: E731, B023
            bad = fill(~valid, True)
            points = pa.StructArray.from_arrays([pa.array(x), pa.array(y)], names=["x", "y"])
            ends = np.concatenate(([0], np.cumsum(fill(n, 0)))).astype(np.int32)
            keys = [b.column(c).take(pa.array(who)) for c in (on, key)]
            yield pa.RecordBatch.from_arrays([
                *keys, pa.array(fill(part, 0)), pa.array(fill(area, 0.0)), pa.ListArray.from_arrays(pa.array(ends), points), reasons.take(pa.array(fill(fault, 4))),
                pa.array(px[who]), pa.array(cx[who]), pa.array(cy[who]), pa.array(fill(index, 0), mask=bad), pa.array(count[who], mask=bad), pa.array(total[who], mask=bad),
            ], names=[on, key, "part", "part_area", "ring", "reason", "area_px", "cx", "cy", "part_index", "part_count", "exported_area"])

    schema = f"{on} long, {key} long, part long, part_area double, ring array<struct<x:double,y:double>>, reason string, area_px long, cx double, cy double, part_index long, part_count long, exported_area double"
    return trace, schema


def object_parts(objects: DataFrame, sizes: DataFrame | None = None, on: str = "slide_id", key: str = "det_id") -> DataFrame:
    """``outline_parts`` of objects whose runs are lists (row, c0, c1).

    A batch of objects is smoothed, walked around, simplified and checked together. Also of each object: area_px and
    centroid cx, cy of its runs; of its valid parts: part_index by falling area, part_count, and exported_area, the sum of their rings.
    """
    objects = objects.select(on, key, "row", "c0", "c1").filter(F.size("row") > 0)
    objects = objects if sizes is None else objects.join(sizes.select(on, "width", "height"), on, "left")
    return objects.mapInArrow(*traced(on, key, sizes is not None))


def painted_parts(boxes: DataFrame, sizes: DataFrame, key: str = "det_id") -> DataFrame:
    """``object_parts`` of ``painting.visible_objects``, traced where they are painted."""
    end = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(HUGE)).alias(c)
    sized = boxes.select("slide_id", key, "score", *BOX).join(sizes.select("slide_id", "width", "height"), "slide_id", "left")
    then, schema = traced("slide_id", key, True)
    return visible_objects(sized.select("slide_id", key, "score", *BOX, end("width"), end("height")), key, carried=("width", "height"), then=then, schema=schema)


def outline_features(cells: DataFrame | None, parts: DataFrame, on: str = "slide_id", key: str = "det_id", name: str = "Cell", color: tuple[int, int, int] = (255, 0, 0)) -> DataFrame:
    """(on, key, part_index, part_count, ring, exported_area, mismatch, feature) of the valid parts of cells (on, key, area_px, cx, cy), by default those of the parts' runs.

    Parts are numbered by falling area; names of several parts say which. ``mismatch``
    flags cells of which less than half of the area is in the rings.
    """
    valid = parts.filter("reason IS NULL")
    joined = valid if cells is None else cells.select(on, key, "area_px", "cx", "cy").join(valid.drop("area_px", "cx", "cy"), [on, key])
    many = F.col("part_count") > 1
    points = F.transform("ring", lambda p: F.array(p["x"], p["y"]))
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Polygon").alias("type"), F.array(F.concat(points, F.slice(points, 1, 1))).alias("coordinates")).alias("geometry"),
        F.struct(
            F.concat(F.lit(f"{name} "), F.col(key), F.when(many, F.concat(F.lit(" part "), "part_index")).otherwise("")).alias("name"), F.lit("annotation").alias("objectType"),
            F.struct(F.lit(name).alias("name"), F.array(*[F.lit(c) for c in color]).alias("colorRGB")).alias("classification"),
            F.col("area_px").alias("area_pixels"), F.col("cx").alias("centroid_x"), F.col("cy").alias("centroid_y"), F.col(key).alias("cell_id"),
            F.when(many, F.col("part_index")).alias("part_index"), F.when(many, F.col("part_count")).alias("part_count"),
        ).alias("properties"),
    )
    return joined.select(on, key, "part_index", "part_count", "ring", "exported_area", (F.col("exported_area") < 0.5 * F.col("area_px")).alias("mismatch"), F.to_json(feature).alias("feature"))
