"""Folds of the samples along a ray (arrays in walking order) into one grey value.

Each fold is an `aggregate` over the array whose state freezes once the opacity reaches the cutoff, which is the early
stop of a front-to-back walk.  Sums are DOUBLE.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxelarium.functions.voxel import clamp
from voxelarium.model import Compositing


def _unit(x: Column, c: Compositing) -> Column:
    return clamp((x / 255.0 - c.low) / (c.high - c.low), 0.0, 1.0)


def _gray(x: Column) -> Column:
    return F.floor(clamp(x * 255.0, 0.0, 255.0)).cast("int")


def _state(**parts) -> Column:
    return F.struct(*[(v if isinstance(v, Column) else F.lit(float(v))).alias(k) for k, v in parts.items()])


def top(samples: Column) -> Column:
    return F.coalesce(F.array_max(samples), F.lit(0))


def nothing(samples: Column) -> Column:
    return F.lit(0)


def alpha(samples: Column, c: Compositing) -> Column:
    def step(s, x):
        q = _unit(x, c)
        w = (1.0 - s["a"]) * F.least(q * c.strength, F.lit(1.0))
        live = (q > 0) & (s["a"] < c.stop)
        return F.when(live, _state(v=s["v"] + w * q, a=s["a"] + w)).otherwise(s)

    return F.aggregate(samples, _state(v=0, a=0), step, lambda s: _gray(s["v"]))


def height_map(samples: Column, c: Compositing, layers: Column | int) -> Column:
    """Mean depth weighted by opacity, bright in front; 0 where nothing is hit."""
    def step(s, x):
        q = _unit(x, c)
        w = (1.0 - s["a"]) * F.least(q * c.strength, F.lit(1.0))
        hit = _state(a=s["a"] + w, d=s["d"] + 1.0, wd=s["wd"] + w * s["d"])
        miss = _state(a=s["a"], d=s["d"] + 1.0, wd=s["wd"])
        return F.when(s["a"] >= c.stop, s).when(q == 0, miss).otherwise(hit)

    n = layers if isinstance(layers, Column) else F.lit(layers)
    done = lambda s: F.coalesce(F.floor(clamp(255.0 - F.try_divide(s["wd"], s["a"]) * 255.0 / n, 0.0, 255.0)), F.lit(0)).cast("int")
    return F.aggregate(samples, _state(a=0, d=0, wd=0), step, done)


def overlay_opacity(base: Column, overlay: Column, c: Compositing) -> Column:
    """Opacity from the overlay, value from the base."""
    def step(s, x):
        a = _unit(x["o"], c)
        w = (1.0 - s["a"]) * F.least(a * c.strength, F.lit(1.0))
        live = (a > 0) & (s["a"] < c.stop)
        return F.when(live, _state(v=s["v"] + w * (x["b"] / 255.0), a=s["a"] + w)).otherwise(s)

    return F.aggregate(_pairs(base, overlay), _state(v=0, a=0), step, lambda s: _gray(s["v"]))


def _pairs(base: Column, overlay: Column) -> Column:
    return F.zip_with(base, overlay, lambda b, o: F.struct(b.alias("b"), o.alias("o")))


def overlay_start(base: Column, overlay: Column, c: Compositing) -> Column:
    """The alpha walk of the base from the first overlay sample above the low mark (from the start if there is none)."""
    hits = F.transform(overlay, lambda o: o / 255.0 > c.low)
    onset = F.greatest(F.array_position(hits, F.lit(True)), F.lit(1)).cast("int")
    return alpha(F.slice(base, onset, F.greatest(F.size(base) - onset + 1, F.lit(0))), c)


def overlay_combined(base: Column, overlay: Column, c: Compositing) -> Column:
    """Crossfade of the walk masked by the overlay and the plain walk."""
    def step(s, x):
        q = _unit(x["b"], c)
        m = q * (x["o"] / 255.0)
        wm = (1.0 - s["ma"]) * F.least(m * c.strength, F.lit(1.0))
        wr = (1.0 - s["ra"]) * F.least(q * c.strength, F.lit(1.0))
        lm, lr = (q > 0) & (m > 0) & (s["ma"] < c.stop), (q > 0) & (s["ra"] < c.stop)
        add = lambda k, w, live, by=None: s[k] + F.when(live, w * by if by is not None else w).otherwise(0.0)
        return _state(mv=add("mv", wm, lm, q), ma=add("ma", wm, lm), rv=add("rv", wr, lr, q), ra=add("ra", wr, lr))

    def done(s):
        masked = s["mv"] if c.value_norm >= 1.0 else F.when(s["ma"] > 0, s["mv"] / s["ma"] * F.pow(s["ma"], F.lit(c.value_norm))).otherwise(0.0)
        return _gray((1.0 - c.background) * masked + c.background * s["rv"])

    return F.aggregate(_pairs(base, overlay), _state(mv=0, ma=0, rv=0, ra=0), step, done)


#: Folds of further modes: name to a function of (samples, overlay samples or None, parameters, number of layers).
CUSTOM: dict[str, Callable[[Column, Column | None, Compositing, Column | int], Column]] = {}


def register(mode: str, fold: Callable[[Column, Column | None, Compositing, Column | int], Column]) -> None:
    """Add a compositing mode."""
    CUSTOM[mode] = fold


def composite(c: Compositing, base: Column, overlay: Column | None = None, layers: Column | int | None = None) -> Column:
    """The fold of a mode; modes that need an overlay fall back to alpha without one."""
    n = layers if layers is not None else F.size(base)
    if c.mode in CUSTOM:
        return CUSTOM[c.mode](base, overlay, c, n)
    if c.mode == "max":
        return top(base)
    if c.mode == "none":
        return nothing(base)
    if c.mode == "heightmap":
        return height_map(base, c, n)
    if overlay is not None and c.mode in _OVER:
        return _OVER[c.mode](base, overlay, c)
    if c.mode == "alpha" or c.mode in _OVER:
        return alpha(base, c)
    raise ValueError(f"no compositing mode is called {c.mode}")


_OVER = {"overlay_opacity": overlay_opacity, "overlay_start": overlay_start, "overlay_combined": overlay_combined}
