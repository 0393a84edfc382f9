"""Scalar functions over columns, all inside the JVM."""

from __future__ import annotations

import re
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Length units in micrometres
MICRONS = {
    "µm": 1.0, "um": 1.0, "micron": 1.0, "microns": 1.0, "micrometer": 1.0, "micrometers": 1.0, "micrometre": 1.0, "micrometres": 1.0,
    "nm": 0.001, "nanometer": 0.001, "nanometers": 0.001, "nanometre": 0.001, "nanometres": 0.001,
    "mm": 1000.0, "millimeter": 1000.0, "millimeters": 1000.0, "millimetre": 1000.0, "millimetres": 1000.0,
    "cm": 10000.0, "centimeter": 10000.0, "centimeters": 10000.0, "centimetre": 10000.0, "centimetres": 10000.0,
    "m": 1000000.0, "meter": 1000000.0, "meters": 1000000.0, "metre": 1000000.0, "metres": 1000000.0,
}
# Colours (red, green, blue) of tumour instances in turn
PALETTE = [(230, 57, 70), (29, 185, 84), (0, 118, 182), (255, 183, 3), (131, 56, 236), (251, 133, 0), (42, 157, 143), (255, 0, 110), (88, 129, 87), (67, 97, 238)]
# Lines of a progress log, as formats with {n} for a number, {text} for the rest of a line and {word} for a name
LOG_LINES = {
    "image": "Processing image {n}/{n}: {text}",
    "found": "Found {n} images to process",
    "done": "Successfully processed: {n}/{n} images",
    "remaining": "Processing {n} remaining images out of {n} total",
    "probe": "GPU_PROBE_STAGE: {word}",
    "runtime": "GPU_RUNTIME_STAGE: {word}",
}
# Parts of messages that tell of exhausted memory
MEMORY_WORDS = ["memory", "out of memory", "oom", "cannot allocate", "cannot read raw tile"]
# Log symbols and their ASCII forms
ASCII_FORMS = {"•": "-", "µ": "u", "μ": "u", "²": "^2", "×": "x", "–": "-", "—": "-", "−": "-", "→": "->", "←": "<-", "↔": "<->"}


def px_to_um2(area: Column, mpp: Column) -> Column:
    return area * mpp * mpp


def um2_to_px(um2: Column | float, mpp: Column) -> Column:
    """Area in pixels, truncated."""
    return F.floor((um2 if isinstance(um2, Column) else F.lit(float(um2))) / (mpp * mpp)).cast("long")


def quantile_cont(values: Column, p: float) -> Column:
    """The quantile ``p`` of an ascending array without nulls, to the bit as DuckDB's quantile_cont; null if it is empty.

    Between two values DuckDB rounds once, by a fused multiply-add, and F.percentile
    twice: values on the border of a bin then fall on different sides of it.
    """
    at = (F.size(values) - 1) * F.lit(float(p))
    low, high = F.get(values, F.floor(at).cast("int")).cast("double"), F.get(values, F.ceil(at).cast("int")).cast("double")
    part = at - F.floor(at)
    return F.when(F.size(values) > 0, F.java_method(F.lit("java.lang.Math"), F.lit("fma"), low, 1 - part, high * part).cast("double"))


def valid_mpp(x: Column) -> Column:
    """x if it is a positive finite number, else null."""
    v = x.try_cast("double")
    return F.when((v > 0) & ~F.isnan(v) & (v < float("inf")), v)


def mpp_of(*candidates: Column, default: float = 0.5) -> Column:
    """The first valid candidate, else the default."""
    return F.coalesce(*[valid_mpp(c) for c in candidates], F.lit(default))


def unit_factor(unit: Column) -> Column:
    """Micrometres per unit; a missing or blank unit is µm, an unknown one null. Greek mu and micro sign are one."""
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(MICRONS.items())])
    name = F.translate(F.lower(F.trim(F.coalesce(unit, F.lit("")))), "μ", "µ")
    return F.try_element_at(table, F.when(name == "", "um").otherwise(name))


def pair_mpp(x: Column, y: Column, unit_x: Column, unit_y: Column) -> Column:
    """Mean of two sizes in micrometres; null unless both are valid."""
    one = lambda v, u: valid_mpp(v) * unit_factor(u)
    return (one(x, unit_x) + one(y, unit_y)) / 2


def grid_id(cx: Column, cy: Column, width: Column, height: Column, mpp: Column, cell_um: float = 1100.0) -> Column:
    """Row-major number of the grid cell of a centroid, clamped to the grid."""
    g = F.greatest(F.lit(1), F.floor(F.lit(cell_um) / mpp)).cast("long")
    cols, rows = F.ceil(width / g), F.ceil(height / g)
    clamp = lambda v, n: F.least(F.greatest(F.floor(v / g), F.lit(0)), n - 1)
    return (clamp(cy, rows) * cols + clamp(cx, cols)).cast("long")


def distance_bin(d: Column, close: float = 100.0, medium: float = 500.0) -> Column:
    """Right-closed bins; null stays null."""
    return F.when(d.isNull(), None).when(d <= close, "Close").when(d <= medium, "Medium").otherwise("Far")


def zone_thresholds(mpp: Column, scale: float, near_um: float = 1500.0, far_um: float = 5000.0) -> tuple[Column, Column]:
    """Zone borders in pixels, repaired so that 1 <= near < intermediate."""
    near_um = near_um if near_um > 0 else 1500.0
    far_um = far_um if far_um > near_um else near_um + 1.0
    near = F.greatest(F.rint(F.lit(near_um) / mpp * scale).cast("long"), F.lit(1))
    far = F.greatest(F.rint(F.lit(far_um) / mpp * scale).cast("long"), near + 1)
    return near, far


def zone(d_px: Column, near: Column, far: Column) -> Column:
    """Zone of a distance; inside the tumour (0) there is none."""
    return F.when(d_px <= 0, None).when(d_px <= near, "near").when(d_px <= far, "intermediate").otherwise("distal")


def safe_scale(width: Column, height: Column, requested: float, max_px: int = 250_000_000) -> Column:
    if requested <= 0:
        return F.lit(0.0)
    return F.least(F.lit(float(requested)), F.sqrt(F.lit(float(max_px)) / F.greatest(F.lit(1), width * height)))


def thumb(v: Column, scale: Column, limit: Column) -> Column:
    """Half-to-even rounded thumbnail coordinate, clamped to 0..limit."""
    return F.greatest(F.lit(0), F.least(F.rint(v * scale).cast("long"), limit))


def truncated(v: Column) -> Column:
    return F.when(v < 0, F.ceil(v)).otherwise(F.floor(v)).cast("long")


def hhmmss(seconds: Column) -> Column:
    s = F.floor(seconds).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def bytes_text(n: Column, units: tuple[str, ...] = ("B", "KB", "MB", "GB", "TB")) -> Column:
    """Size with one decimal, halves to even, in the first of ``units`` that keeps it below 1024, else in the last."""
    n = n.cast("double")

    def text(i: int) -> Column:
        size = 1024.0**i
        whole = F.floor(F.abs(n) / size)
        tenths = F.rint((F.abs(n) - whole * size) * 10 / size)  # exact for whole n: no decimal text is rounded again
        return F.format_string(f"%.1f {units[i]}", F.when(n < 0, -1.0).otherwise(1.0) * (whole + tenths / 10))

    out = text(len(units) - 1)
    for i in reversed(range(len(units) - 1)):
        out = F.when(F.abs(n) / 1024.0**i < 1024, text(i)).otherwise(out)
    return out


def blank_unless_positive(x: Column, digits: int = 2) -> Column:
    """Text with ``digits`` decimals, halves to even; empty unless positive."""
    return F.when(x > 0, F.format_string(f"%.{digits}f", F.bround(x, digits))).otherwise("")


def tumor_color(tumor_id: Column) -> Column:
    palette = F.array(*[F.lit("#" + bytes(c).hex()) for c in PALETTE])
    return F.element_at(palette, (F.pmod(F.greatest(F.lit(1), tumor_id) - 1, F.lit(len(PALETTE))) + 1).cast("int"))


def seeded_color(label: Column, seed: int = 42) -> Column:
    """A colour drawn from a label and a seed, the same in every run."""
    return F.concat(F.lit("#"), F.lower(F.lpad(F.hex(F.pmod(F.xxhash64(label, F.lit(seed)), F.lit(1 << 24))), 6, "0")))


def opacity(x: Column, default: float = 0.35) -> Column:
    v = x.try_cast("double")
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), default).otherwise(v)))


def is_memory_error(message: Column) -> Column:
    return F.lower(message).rlike("|".join(MEMORY_WORDS))


def cache_key(*parts: Column) -> Column:
    return F.md5(F.concat_ws("_", *[p.cast("string") for p in parts]))


def multiple_of_8(n: Column) -> Column:
    """Rounded up to a multiple of 8 unless that more than doubles it."""
    up = F.floor((n + 7) / 8).cast("long") * 8
    return F.when(up > n * 2, n).otherwise(up)


def iou_above(inter: Column, union: Column, num: int, den: int) -> Column:
    """inter / union > num / den, in integers."""
    return inter * den > union * num


def box_overlap(a: str, b: str) -> Column:
    """Strict overlap of the boxes of two aliases: touching boxes do not overlap."""
    c = lambda t, n: F.col(f"{t}.{n}")
    return (c(a, "x1") < c(b, "x2")) & (c(b, "x1") < c(a, "x2")) & (c(a, "y1") < c(b, "y2")) & (c(b, "y1") < c(a, "y2"))


def without_ansi(line: Column) -> Column:
    """A line without terminal escapes: ESC [, parameters, and a final letter or sign."""
    return F.regexp_replace(line, "\u001b" + r"\[[\x30-\x3f]*[\x20-\x2f]*[\x40-\x7e]", "")


def line_pattern(form: str) -> str:
    """A pattern for lines of a format of LOG_LINES: any case, any space where the format has some or a sign."""
    parts = re.split(r"(\{\w+\}|[/:]|\s+)", form)
    known = {"{n}": r"(\d+)", "{text}": "(.+)$", "{word}": r"(\w+)", "/": r"\s*/\s*", ":": r":\s*"}
    return "(?i)" + "".join(known.get(x, r"\s+" if x.isspace() else re.escape(x)) for x in parts).replace(r"\s*\s+", r"\s*")


def progress_of(line: Column) -> Column:
    """Parts of a log line: image number, total, name, finished and remaining counts, stage."""
    line = without_ansi(line)
    part = lambda form, g: F.nullif(F.regexp_extract(line, line_pattern(LOG_LINES[form]), g), F.lit(""))
    number = lambda form, g: part(form, g).try_cast("long")
    return F.struct(
        number("image", 1).alias("image"), number("image", 2).alias("images"), part("image", 3).alias("name"), number("found", 1).alias("found"),
        number("done", 1).alias("done"), number("remaining", 1).alias("remaining"), F.coalesce(part("probe", 1), part("runtime", 1)).alias("stage"),
    )


def run_name(folder: Column, prefix: str = "results_") -> Column:
    """Name in a result folder ``<prefix><name>_<YYYYMMDD>_<HHMMSS>``; null for other names."""
    return F.nullif(F.regexp_extract(folder, rf"^{prefix}(.+)_(\d{{8}})_(\d{{6}})$", 1), F.lit(""))


# --- rings: arrays of struct<x, y>, not closed ---------------------------------


def ring_area(ring: Column) -> Column:
    """Shoelace area, absolute."""
    nxt = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(1))), F.slice(ring, 1, 1))
    cross = F.zip_with(ring, nxt, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0)))) / 2
