"""Column expressions: addresses, filters, interpolation, geometry, colours, names.  All stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxelarium.model import Affine, Coloring, Filter


def lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def idiv(a: Column, b) -> Column:
    """Integer quotient, truncated toward zero."""
    return F.call_function("div", a, lit(b))


def trunc_int(x: Column) -> Column:
    return x.cast("int")


def clamp(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, lit(low)), lit(high))


# ---- transforms as arrays of twelve numbers, row by row ----
def affine_then(first: Column, after: Column) -> Column:
    """The map that applies one transform and then another; a null one changes nothing."""
    a, b = (lambda i, j: first[4 * i + j]), (lambda i, j: after[4 * i + j])
    cells = [b(i, 0) * a(0, j) + b(i, 1) * a(1, j) + b(i, 2) * a(2, j) + (b(i, 3) if j == 3 else F.lit(0.0)) for i in range(3) for j in range(4)]
    return F.when(first.isNull(), after).when(after.isNull(), first).otherwise(F.array(*cells))


def affine_scale(m: Column) -> Column:
    """Mean length of the images of the axes; 1 without a transform."""
    axis = [F.sqrt(m[j] * m[j] + m[4 + j] * m[4 + j] + m[8 + j] * m[8 + j]) for j in range(3)]
    return F.when(m.isNull(), 1.0).otherwise((axis[0] + axis[1] + axis[2]) / 3.0)


# ---- addresses ----
def chunk_of(x: Column, bits: int = 6) -> Column:
    return F.shiftright(x, bits)


def inner_of(x: Column, bits: int = 6) -> Column:
    return x.bitwiseAND(F.lit((1 << bits) - 1))


def inner_offset(x: Column, y: Column, z: Column, bits: int = 6) -> Column:
    """Offset of a voxel in its dense chunk: x fastest."""
    return F.shiftleft(inner_of(z, bits), 2 * bits) + F.shiftleft(inner_of(y, bits), bits) + inner_of(x, bits)


def shard_of(cx: Column, cy: Column, cz: Column, bits: int = 7) -> tuple[Column, Column, Column, Column]:
    """Shard coordinates and the chunk's place in its shard."""
    return (F.shiftright(cx, bits), F.shiftright(cy, bits), F.shiftright(cz, bits), F.shiftleft(F.shiftleft(inner_of(cz, bits).cast("long"), bits) + inner_of(cy, bits), bits) + inner_of(cx, bits))


def linear_index(x: Column, y: Column, z: Column, nx, ny) -> Column:
    return (z.cast("long") * lit(ny) + y) * lit(nx) + x


def from_linear(i: Column, nx, ny) -> tuple[Column, Column, Column]:
    return i % lit(nx), idiv(i, nx) % lit(ny), idiv(i, lit(nx) * lit(ny))


def page_index(x: Column, y: Column, z: Column) -> Column:
    """Index in the layout of 16-voxel pages of 4-voxel lines: page, then line, then address."""
    page = F.shiftleft(F.shiftright(z, 4).cast("long"), 16) + F.shiftleft(F.shiftright(y, 4).cast("long"), 8) + F.shiftright(x, 4)
    line = F.shiftleft(F.shiftright(z, 2).bitwiseAND(F.lit(3)), 4) + F.shiftleft(F.shiftright(y, 2).bitwiseAND(F.lit(3)), 2) + F.shiftright(x, 2).bitwiseAND(F.lit(3))
    inner = F.shiftleft(z.bitwiseAND(F.lit(3)), 4) + F.shiftleft(y.bitwiseAND(F.lit(3)), 2) + x.bitwiseAND(F.lit(3))
    return F.shiftleft(page, 12) + F.shiftleft(line, 6) + inner


def out_of_bounds(cx: Column, cy: Column, cz: Column, lod: Column, extent, max_lod: int, size: int = 64) -> Column:
    """Outside the chunk grid of a level, or above the last level."""
    n = [idiv(lit(e) + F.shiftleft(F.lit(size), lod) - 1, F.shiftleft(F.lit(size), lod)) for e in extent]
    return (lod > max_lod) | (cx < 0) | (cy < 0) | (cz < 0) | (cx >= n[0]) | (cy >= n[1]) | (cz >= n[2])


def shift_level(x: Column, from_lod: int, to_lod: int) -> Column:
    return F.shiftright(x, to_lod - from_lod) if to_lod >= from_lod else F.shiftleft(x, from_lod - to_lod)


def inside(x: Column, y: Column, z: Column, extent, lod: int = 0) -> Column:
    """A sample counts only where its full-resolution place lies within the extent."""
    return (x >= 0) & (y >= 0) & (z >= 0) & (F.shiftleft(x, lod) < extent[0]) & (F.shiftleft(y, lod) < extent[1]) & (F.shiftleft(z, lod) < extent[2])


# ---- filters ----
def filtered(v: Column, f: Filter) -> Column:
    """Threshold, quantise, mask and rescale; the identity when inactive.  A zero span of thresholds gives 0."""
    if not f.active:
        return v
    span = 255 - (f.threshold_min + f.threshold_max)
    if span == 0:
        return F.lit(0)
    raised = F.least(idiv(F.greatest(v - f.threshold_min, F.lit(0)) * 255, span), F.lit(255))
    return trunc_int(raised.bitwiseAND(F.lit(f.mask)).cast("double") / F.lit(float(f.mask)) * 255.0)


# ---- interpolation ----
def q8(fraction: Column) -> Column:
    """A fraction as an integer weight below 256."""
    return (fraction * 256).cast("int")


def trilinear_weight(dx, dy, dz, fx: Column, fy: Column, fz: Column, one: int | float = 1.0) -> Column:
    """Weight of the corner (dx, dy, dz) of a cell for fractions of `one`."""
    side = lambda d, f: F.when(lit(d) == 1, f).otherwise(F.lit(one) - f)
    return side(dx, fx) * side(dy, fy) * side(dz, fz)


def bilinear(p00: Column, p10: Column, p01: Column, p11: Column, dx: Column, dy: Column) -> Column:
    return p00 * ((1 - dx) * (1 - dy)) + p10 * (dx * (1 - dy)) + p01 * ((1 - dx) * dy) + p11 * (dx * dy)


# ---- geometry ----
def affine(a: Affine, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    return tuple(x * r[0] + y * r[1] + z * r[2] + F.lit(r[3]) for r in a.rows)


def affine_normal(a: Affine, x: Column, y: Column, z: Column, zero_short: bool = True) -> tuple[Column, Column, Column]:
    """The linear part, renormalised; short vectors become zero, or null where zero_short is off."""
    p = [x * r[0] + y * r[1] + z * r[2] for r in a.rows]
    n = F.sqrt(p[0] * p[0] + p[1] * p[1] + p[2] * p[2])
    if zero_short:
        return tuple(F.when(n > 1e-6, c / n).otherwise(0.0) for c in p)
    return tuple(F.try_divide(c, n) for c in p)


def sign_from(x: Column) -> Column:
    """1 from zero upward, -1 below: the sign that makes an edge touch a plane once."""
    return F.when(x >= 0, 1).otherwise(-1)


def crosses(a: Column, b: Column, w) -> Column:
    return sign_from(a - lit(w)) != sign_from(b - lit(w))


def crossing(a: Column, b: Column, w) -> Column:
    """Share of the way from a to b at which w lies."""
    return F.try_divide(a - lit(w), (a - lit(w)) - (b - lit(w)))


def orient(u1, v1, u2, v2, u3, v3) -> Column:
    """Twice the signed area of a triangle."""
    return (u2 - u1) * (v3 - v1) - (v2 - v1) * (u3 - u1)


def align_down(v: Column, step: int) -> Column:
    return idiv(v, step) * step


def align_up(v: Column, step: int) -> Column:
    return idiv(v + (step - 1), step) * step


# ---- colours: structs of r, g, b in 0..255 ----
def rgb(r, g, b) -> Column:
    return F.struct(lit(r).cast("int").alias("r"), lit(g).cast("int").alias("g"), lit(b).cast("int").alias("b"))


def _sector(h: Column, c: Column, x: Column, zero: Column):
    """(r, g, b) of a hue sector 0..5."""
    pick = lambda order: F.element_at(F.array(*order), F.least(F.floor(h).cast("int"), F.lit(5)) + 1)
    return pick((c, x, zero, zero, x, c)), pick((x, c, c, x, zero, zero)), pick((zero, zero, x, c, c, x))


def hsv(h_deg: Column, s, v, rounding: bool = False) -> Column:
    """Hue, saturation and value to colour: truncated, or rounded."""
    h = F.pmod(h_deg, F.lit(360.0)) / 60.0
    c = lit(v) * lit(s)
    x = c * (1.0 - F.abs(F.pmod(h, F.lit(2.0)) - 1.0))
    parts = _sector(h, c, x, F.lit(0.0))
    m = lit(v) - c
    step = (lambda y: F.floor(y + 0.5)) if rounding else F.floor
    return rgb(*[step((p + m) * 255.0) for p in parts])


def hue_saturation(color: Column) -> tuple[Column, Column]:
    r, g, b = (color[k] / 255.0 for k in "rgb")
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    d = high - low
    light = (high + low) * 0.5
    s = F.when(light > 0.5, F.try_divide(d, 2.0 - high - low)).otherwise(F.try_divide(d, high + low))
    h = F.when(high == r, F.pmod(F.try_divide(g - b, d), F.lit(6.0))).when(high == g, F.try_divide(b - r, d) + 2.0).otherwise(F.try_divide(r - g, d) + 4.0)
    return F.when(d < 1e-6, 0.0).otherwise(h * 60.0), F.when(d < 1e-6, 0.0).otherwise(s)


def label_color(v: Column, c: Coloring) -> tuple[Column, Column]:
    """(colour, strength) of a label value; both null where nothing is painted."""
    if c.kind == "four":
        color = F.when(v == 1, rgb(255, 0, 0)).when(v == 2, rgb(0, 255, 0)).when(v == 3, rgb(255, 255, 0)).otherwise(rgb(0, 0, 255))
        return F.when(v != 0, color), F.when(v != 0, F.lit(c.alpha))
    if c.kind == "boolean":
        return F.when(v == 255, rgb(*c.color)), F.when(v == 255, F.lit(c.alpha))
    return F.when(v != 0, hsv(F.lit(c.hue), 1.0, 1.0)), F.when(v != 0, v / 255.0 * c.alpha)


def blend_alpha(base: Column, color: Column, alpha: Column) -> Column:
    return rgb(*[F.floor(base[k] * (1.0 - alpha) + color[k] * alpha) for k in "rgb"])


def hue_of(color: tuple[int, int, int]) -> tuple[float, float]:
    """(hue in degrees, saturation) of a constant colour, on the driver."""
    r, g, b = (x / 255.0 for x in color)
    high, low = max(r, g, b), min(r, g, b)
    d = high - low
    if d < 1e-6:
        return 0.0, 0.0
    s = d / (2.0 - high - low) if (high + low) * 0.5 > 0.5 else d / (high + low)
    h = (g - b) / d % 6.0 if high == r else (b - r) / d + 2.0 if high == g else (r - g) / d + 4.0
    return h * 60.0, s


def blend_multiply(gray: Column, color: tuple[int, int, int], strength: Column) -> Column:
    """Hue and saturation of a constant colour at the lightness of a grey value."""
    hue, saturation = hue_of(color)
    h = hue % 360.0 / 60.0
    share = 1.0 - abs(h % 2.0 - 1.0)
    light = gray / 255.0
    c = (1.0 - F.abs(2.0 * light - 1.0)) * (saturation * clamp(strength, 0.0, 1.0))
    full, part, none = c, c * share, F.lit(0.0)
    order = [(full, part, none), (part, full, none), (none, full, part), (none, part, full), (part, none, full), (full, none, part)][min(int(h), 5)]
    return rgb(*[F.floor(clamp((p + (light - c * 0.5)) * 255.0, 0.0, 255.0)) for p in order])


def label_cases(v: Column, c: Coloring) -> list[tuple[Column, tuple[int, int, int]]]:
    """The colours a label colouring can paint, each with its condition."""
    if c.kind == "four":
        return [(v == 1, (255, 0, 0)), (v == 2, (0, 255, 0)), (v == 3, (255, 255, 0)), (v != 0, (0, 0, 255))]
    return [(v == 255, c.color)] if c.kind == "boolean" else [(v != 0, constant_hsv(c.hue))]


def constant_hsv(hue: float) -> tuple[int, int, int]:
    """The pure colour of a hue, truncated to bytes."""
    h = hue % 360.0 / 60.0
    x = 1.0 - abs(h % 2.0 - 1.0)
    return tuple(int(y * 255.0) for y in [(1, x, 0), (x, 1, 0), (0, 1, x), (0, x, 1), (x, 0, 1), (1, 0, x)][min(int(h), 5)])


def tinted(gray: Column, label: Column, c: Coloring) -> Column:
    """A grey value under a label colouring; grey where the label paints nothing."""
    strength = label / 255.0 * c.alpha if c.kind == "hue" else F.lit(c.alpha)
    base = rgb(gray, gray, gray)
    out = None
    for when, color in label_cases(label, c):
        mixed = blend_alpha(base, rgb(*color), strength) if c.mode == "alpha" else blend_multiply(gray, color, strength)
        out = F.when(when, mixed) if out is None else out.when(when, mixed)
    return out.otherwise(base)


def state_color(target_lod: Column, chosen_lod: Column, state: Column, downloading: Column) -> Column:
    """Debug colour of a chunk: how it was resolved; null for none."""
    return (
        F.when(state == "empty", rgb(60, 200, 110))
        .when(chosen_lod == target_lod, F.lit(None))
        .when(chosen_lod.isNotNull(), F.when(downloading, rgb(40, 200, 220)).otherwise(rgb(60, 130, 230)))
        .when(state == "pending", F.when(downloading, rgb(230, 140, 40)).otherwise(rgb(230, 200, 40)))
        .when(state == "cooldown", rgb(220, 60, 60))
        .when((state == "missing") | state.isNull(), rgb(220, 60, 220))
    )


# ---- names ----
def cache_key(url: Column) -> Column:
    """sha256 of a url without its last slash."""
    return F.sha2(F.regexp_replace(url, "/$", ""), 256)


def volume_key(url: Column, volume_id: Column) -> Column:
    return F.concat(F.substring(cache_key(url), 1, 16), F.lit("__"), volume_id)


def url_host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/]*)", 1)


def url_join(root: Column, path: Column) -> Column:
    return F.concat(F.regexp_replace(root, "/+$", ""), F.lit("/"), F.regexp_replace(path, "^/+", ""))


def http_outcome(status: Column) -> Column:
    """Data, a definite absence, a delay of the tile server, or a failure worth another try."""
    return F.when(status.isin(200, 206), "data").when(status.isin(403, 404), "absent").when(status == 420, "delayed").otherwise("transient")
