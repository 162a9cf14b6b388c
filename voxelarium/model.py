"""Plain parameter types: transforms, views, compositing and drawing settings, and their text forms."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

import numpy as np

CHUNK = 64
CHUNK_BYTES = CHUNK**3


@dataclass(frozen=True)
class Affine:
    """A 3x4 map of points; composed, inverted and scaled on the driver, applied as column expressions."""

    rows: tuple[tuple[float, float, float, float], ...]

    @classmethod
    def uniform(cls, f: float) -> Affine:
        return cls(((f, 0.0, 0.0, 0.0), (0.0, f, 0.0, 0.0), (0.0, 0.0, f, 0.0)))

    @classmethod
    def parse(cls, text: str) -> Affine:
        """An inline 3x4 array, or an object with `transformation_matrix`."""
        x = json.loads(text)
        m = x["transformation_matrix"] if isinstance(x, dict) else x
        m = np.asarray(m, float)
        if m.shape == (12,):
            m = m.reshape(3, 4)
        if m.shape == (4, 4):
            m = m[:3]
        if m.shape != (3, 4):
            raise ValueError(f"a transform has 3x4 numbers, not {m.shape}")
        return cls(tuple(map(tuple, m.tolist())))

    def _square(self) -> np.ndarray:
        return np.vstack([np.asarray(self.rows, float), [0, 0, 0, 1]])

    def then(self, after: Affine) -> Affine:
        return Affine(tuple(map(tuple, (after._square() @ self._square())[:3].tolist())))

    def inverted(self) -> Affine:
        m = self._square()
        if abs(np.linalg.det(m[:3, :3])) < 1e-12:
            raise ValueError("the transform has no inverse")
        return Affine(tuple(map(tuple, np.linalg.inv(m)[:3].tolist())))

    def scale(self) -> float:
        """Mean length of the images of the axes."""
        return float(np.linalg.norm(np.asarray(self.rows)[:, :3], axis=0).mean())


#: Axes (u, v, plane) of the pane kinds; 0, 1, 2 are x, y, z or, on a surface, u, v, w.
PANES = {"XY": (0, 1, 2), "XZ": (0, 2, 1), "YZ": (2, 1, 0), "UV": (0, 1, 2), "UW": (0, 2, 1), "VW": (2, 1, 0)}


@dataclass(frozen=True)
class View:
    """A viewport: centre in the volume, the three axes, size in pixels, and the zoom step painted at."""

    center: tuple[int, int, int]
    axes: tuple[int, int, int] = (0, 1, 2)
    width: int = 64
    height: int = 64
    paint_zoom: int = 1
    sfactor: int = 1


@dataclass(frozen=True)
class Filter:
    """Threshold, quantisation and mask of grey values."""

    enabled: bool = True
    threshold_min: int = 0
    threshold_max: int = 0
    quant: int = 8
    mask_shift: int = 0

    @property
    def active(self) -> bool:
        return self.enabled and (self.threshold_min > 0 or self.threshold_max > 0 or self.quant < 8 or self.mask_shift > 0)

    @property
    def mask(self) -> int:
        kept = self.quant if 1 <= self.quant <= 8 else 8
        return ((0xFF << (8 - kept)) & 0xFF) >> self.mask_shift


@dataclass(frozen=True)
class Compositing:
    """How samples along a ray fold into one value.  Sliders are integers; the folds use their fractions."""

    mode: str = "alpha"
    alpha_min: int = 0
    alpha_max: int = 255
    cutoff: int = 9500
    opacity: int = 100
    background: float = 0.0
    value_norm: float = 1.0
    in_front: int = 0
    behind: int = 0
    reverse: bool = False

    @property
    def low(self) -> float:
        return self.alpha_min / 255.0

    @property
    def high(self) -> float:
        return self.alpha_max / 255.0

    @property
    def stop(self) -> float:
        return self.cutoff / 10000.0

    @property
    def strength(self) -> float:
        return self.opacity / 100.0

    def layers(self, w: int = 0) -> tuple[int, ...]:
        """Offsets along the normal in walking order, from in front to behind; reversed, front is where w is less."""
        d = -1 if self.reverse else 1
        return tuple(range(w + d * self.in_front, w - d * (self.behind + 1), -d))


@dataclass(frozen=True)
class Coloring:
    """Label colouring: kind four, boolean or hue; alpha in [0, 1]; mode alpha or multiply."""

    kind: str = "four"
    alpha: float = 0.4
    color: tuple[int, int, int] = (255, 0, 0)
    hue: float = 0.0
    mode: str = "alpha"

    @classmethod
    def parse(cls, text: str) -> Coloring:
        """`four[:alpha[:mode]]`, `boolean:#RRGGBB[:alpha[:mode]]` or `hue:degrees[:alpha[:mode]]`."""
        kind, *rest = text.strip().lower().split(":")
        first = []
        if kind in ("boolean", "hue"):
            if not rest:
                raise ValueError(f"{kind} needs a colour")
            first, rest = rest[:1], rest[1:]
        elif kind != "four":
            raise ValueError(f"no colouring is called {kind}")
        alpha = parse_alpha(rest[0]) if rest else 0.4
        mode = rest[1] if len(rest) > 1 else "alpha"
        if mode not in ("alpha", "multiply"):
            raise ValueError(f"no blend mode is called {mode}")
        return cls(kind, alpha, parse_color(first[0]) if kind == "boolean" else (255, 0, 0), float(first[0]) if kind == "hue" else 0.0, mode)


def parse_alpha(text: str) -> float:
    a = float(text)
    if not 0.0 <= a <= 1.0:
        raise ValueError(f"alpha {text} is outside 0..1")
    return a


def parse_color(text: str) -> tuple[int, int, int]:
    m = re.fullmatch(r"#?([0-9a-fA-F]{2})([0-9a-fA-F]{2})([0-9a-fA-F]{2})", text)
    if not m:
        raise ValueError(f"{text} is not #RRGGBB")
    return tuple(int(x, 16) for x in m.groups())


@dataclass(frozen=True)
class Crop:
    left: int
    top: int
    width: int
    height: int

    @classmethod
    def parse(cls, text: str) -> Crop:
        """`LEFT+TOP-WIDTHxHEIGHT`."""
        m = re.fullmatch(r"(\d+)\+(\d+)-(\d+)x(\d+)", text)
        if not m:
            raise ValueError(f"{text} is not LEFT+TOP-WIDTHxHEIGHT")
        return cls(*map(int, m.groups()))


@dataclass(frozen=True)
class VolumeSpec:
    """A registered volume: an id, a location, its extent and its number of coarser levels."""

    id: str
    location: str
    extent: tuple[int, int, int] = (0, 0, 0)
    max_lod: int = 0
    options: dict = field(default_factory=dict, compare=False)


def synthesised_levels(extent: tuple[int, int, int], max_lod: int, budget: int) -> int:
    """How many further halvings a volume gets: none if its coarsest level has more chunks than the budget, else until
    one chunk holds everything."""
    def chunks(lod: int) -> int:
        n = 1
        for e in extent:
            n *= -(-e // (CHUNK << lod))
        return n

    if chunks(max_lod) > budget:
        return 0
    more = 0
    while chunks(max_lod + more) > 1:
        more += 1
    return more


def paint_zoom(zoom: float, most: int = 32) -> int:
    """The power of two painted at for a zoom factor."""
    if zoom >= 1.0:
        return 1
    n = min(max(int(-(-1.0 // zoom)), 1), most)
    return min(1 << (n - 1).bit_length(), most)


def natural_level(zoom: float, factor: float = 1.0, bias: int = 0) -> int:
    return max(int(factor / zoom).bit_length() - bias, 0)


def purge_target(resident: int, cap_bytes: int, free_bytes: int | None = None, chunk_bytes: int = CHUNK_BYTES, floor_bytes: int = 5 << 30) -> int:
    """Chunks to evict: down to 80 % of the capacity once above 95 %, and enough to leave the floor free on disk."""
    capacity = cap_bytes // chunk_bytes
    high, low = capacity * 95 // 100, capacity * 80 // 100
    target = resident - low if resident > high else 0
    if free_bytes is not None and free_bytes < floor_bytes:
        target = max(target, -(-(floor_bytes - free_bytes) // chunk_bytes))
    return target
