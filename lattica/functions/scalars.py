"""Row-wise encodings: costs, sizes, colours, rounding, label and camera geometry, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lattica.functions import vocab


def finite(x: Column) -> Column:
    """Whether x is neither null, NaN nor infinite."""
    return F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False))


def round_half_up(x: Column, digits: int = 0) -> Column:
    """Nearest, halves towards plus infinity."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def edge_cost(weight: Column, rate: Column) -> Column:
    """A finite weight, else minus the logarithm of a positive rate, else null. An infinite rate costs minus infinity."""
    by_rate = F.when(rate == float("inf"), F.lit(float("-inf"))).when(rate > 0, -F.log(F.when(rate > 0, rate)))
    return F.when(finite(weight), weight).otherwise(F.when(~F.isnan(rate), by_rate))


def centrality_weight(weight: Column) -> Column:
    return F.when((weight > 0) & ~F.isnan(weight), weight).otherwise(F.lit(1.0))


def size_of(value: Column, least: float = 6.0, most: float = 48.0) -> Column:
    """Twice the square root, rounded, between least and most; least for what is null, not finite or not positive."""
    good = finite(value) & (value > 0)
    return F.when(good, F.greatest(F.lit(least), F.least(F.lit(most), round_half_up(2 * F.sqrt(F.when(good, value)))))).otherwise(F.lit(least))


def is_dashed(provenance: Column) -> Column:
    return provenance == "illustrative"


def edge_width(weight: Column, most: Column) -> Column:
    """From 0.6 to 2.4 by the square root of the share of the heaviest; 1 without weights."""
    return F.when(weight.isNotNull() & (most > 0), 0.6 + 1.8 * F.sqrt(F.greatest(F.lit(0.0), weight) / F.nullif(most, F.lit(0.0)))).otherwise(F.lit(1.0))


def community_slot(number: Column) -> Column:
    """Colour by a community's number, counted round the palette, for negative ones too."""
    return F.element_at(F.array(*map(F.lit, vocab.NUMBER_PALETTE)), F.pmod(number.cast("long"), F.lit(len(vocab.NUMBER_PALETTE))).cast("int") + 1)


def normalized_size(size: Column, dpr: Column) -> Column:
    return F.when(finite(size), size / (2 * dpr)).otherwise(size)


def resolved_color(color: Column, theme: Column) -> Column:
    """A colour, or what a map of theme variables has for `var(--name, fallback)`, else the fallback, else null."""
    pattern = r"^\s*var\(\s*(--[\w-]+)\s*(?:,\s*(.*?)\s*)?\)\s*$"
    name, fallback = F.regexp_extract(color, pattern, 1), F.regexp_extract(color, pattern, 2)
    return F.when(name == "", color).otherwise(F.coalesce(F.try_element_at(theme, name), F.when(fallback != "", fallback)))


def label_tier(rank: Column) -> Column:
    """Font size and opacity by a label's rank from 0."""
    pick = lambda a, b, c: F.when(rank < 10, F.lit(a)).when(rank < 32, F.lit(b)).otherwise(F.lit(c))
    return F.struct(pick(12.0, 11.0, 10.0).alias("font_px"), pick(0.95, 0.78, 0.6).alias("opacity"))


def anchor_radius(size: Column) -> Column:
    return F.coalesce(size, F.lit(25.0)) / 2


def label_half_width(label: Column, font: Column) -> Column:
    return F.least(F.lit(240.0), F.length(label) * font * 0.62) / 2


def clamp_label_x(x: Column, label: Column, font: Column, width: Column) -> Column:
    """x kept so that the label stays 8 pixels inside the pane; unchanged in a pane too narrow for it."""
    half = label_half_width(label, font)
    return F.when(half * 2 + 16 > width, x).otherwise(F.least(width - half - 8, F.greatest(half + 8, x)))


def label_rect(x: Column, y: Column, label: Column, font: Column) -> Column:
    half = label_half_width(label, font)
    return F.struct((x - half - 12).alias("left"), (y - 8).alias("top"), (x + half + 12).alias("right"), (y + font * 1.3 + 8).alias("bottom"))


def overlaps(a: Column, b: Column) -> Column:
    """Whether two rectangles share more than an edge."""
    return (a["left"] < b["right"]) & (b["left"] < a["right"]) & (a["top"] < b["bottom"]) & (b["top"] < a["bottom"])


def link_strength(a: Column, b: Column) -> Column:
    return F.when(a == b, F.lit(0.6)).otherwise(F.lit(0.2))


def collide_radius(degree: Column, most: Column) -> Column:
    return 1 + 0.5 * F.sqrt(degree / F.greatest(most, F.lit(1)))


def renderer_for(nodes: Column) -> Column:
    return F.when(nodes > 500, "webgl").otherwise("canvas")


def zoom_factor(delta: Column) -> Column:
    return F.exp(-0.0015 * delta)


def channel_for(kind: Column) -> Column:
    """The channel that a result of a kind is shown by if none is asked for."""
    return F.when(kind == "scores", "brightness").when(kind == "communities", "color-categorical").when(kind == "paths", "foreground").when(kind == "cycles", "edge-pulse").otherwise("none")


def segment_distance2(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Squared distance from a point to a segment, which may be a point."""
    dx, dy = x2 - x1, y2 - y1
    size = dx * dx + dy * dy
    t = F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - x1) * dx + (py - y1) * dy) / F.nullif(size, F.lit(0.0))))).otherwise(F.lit(0.0))
    ex, ey = px - (x1 + t * dx), py - (y1 + t * dy)
    return ex * ex + ey * ey


def css_scale(scale: Column, dpr: Column) -> Column:
    return scale / F.when(dpr == 0, F.lit(1.0)).otherwise(dpr)


def world_to_screen(v: Column, pan: Column, extent: Column, scale: Column) -> Column:
    """One coordinate, from the world to the screen; scale is in CSS pixels."""
    return (v - pan) * scale + extent / 2


def screen_to_world(v: Column, pan: Column, extent: Column, scale: Column) -> Column:
    return (v - extent / 2) / scale + pan


def zoom_around(scale: Column, factor: Column) -> Column:
    return F.least(F.lit(8.0), F.greatest(F.lit(0.05), scale * factor))


def pan_after_zoom(anchor: Column, pan: Column, extent: Column, before: Column, after: Column) -> Column:
    """The pan that leaves the world under a screen anchor where it is."""
    return screen_to_world(anchor, pan, extent, before) - (anchor - extent / 2) / after


def pan_by(pan: Column, delta: Column, scale: Column) -> Column:
    return pan - delta / scale


def eased(start: Column, end: Column, elapsed: Column, duration: float = 320.0) -> Column:
    """Cubic ease-out between two camera values."""
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), elapsed / duration))
    return start + (end - start) * (1 - F.pow(1 - t, F.lit(3.0)))


def pinch_factor(before: Column, now: Column) -> Column:
    return F.when(before > 0, now / F.nullif(before, F.lit(0.0))).otherwise(F.lit(1.0))
