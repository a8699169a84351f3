"""Boxes as ``struct<x0, y0, x1, y1>`` (corners) or ``struct<x, y, w, h>``, as Spark SQL text."""

from __future__ import annotations

SUCCESS_THRESHOLDS = 21


def to_xywh(box: str, smallest: str = "1e-3D") -> str:
    """Corners to position and size, with a smallest side."""
    return (
        f"named_struct('x', {box}.x0, 'y', {box}.y0, 'w', greatest({box}.x1 - {box}.x0, {smallest}),"
        f" 'h', greatest({box}.y1 - {box}.y0, {smallest}))"
    )


def to_xyxy(box: str) -> str:
    return f"named_struct('x0', {box}.x, 'y0', {box}.y, 'x1', {box}.x + {box}.w, 'y1', {box}.y + {box}.h)"


def iou(a: str, b: str) -> str:
    """Intersection over union of two corner boxes; 0 where the union is not positive."""
    w = f"greatest(least({a}.x1, {b}.x1) - greatest({a}.x0, {b}.x0), 0D)"
    h = f"greatest(least({a}.y1, {b}.y1) - greatest({a}.y0, {b}.y0), 0D)"
    area = "(greatest({0}.x1 - {0}.x0, 0D)*greatest({0}.y1 - {0}.y0, 0D))"
    union = f"({area.format(a)} + {area.format(b)} - {w}*{h})"
    return f"CASE WHEN {union} > 0 THEN {w}*{h}/greatest({union}, 1e-12D) ELSE 0D END"


def iou_xywh(a: str, b: str) -> str:
    """Intersection over union of two position/size boxes."""
    w = f"greatest(least({a}.x + {a}.w, {b}.x + {b}.w) - greatest({a}.x, {b}.x), 0D)"
    h = f"greatest(least({a}.y + {a}.h, {b}.y + {b}.h) - greatest({a}.y, {b}.y), 0D)"
    return f"({w}*{h}/nullif({a}.w*{a}.h + {b}.w*{b}.h - {w}*{h}, 0D))"


def covered_xywh(a: str, b: str) -> str:
    """Share of the first position/size box that the second covers."""
    w = f"greatest(least({a}.x + {a}.w, {b}.x + {b}.w) - greatest({a}.x, {b}.x), 0D)"
    h = f"greatest(least({a}.y + {a}.h, {b}.y + {b}.h) - greatest({a}.y, {b}.y), 0D)"
    return f"({w}*{h}/nullif({a}.w*{a}.h, 0D))"


def success(iou_value: str, thresholds: int = SUCCESS_THRESHOLDS) -> str:
    """Share of equally spaced thresholds in [0, 1] that the overlap exceeds."""
    last = thresholds - 1
    return f"size(filter(sequence(0, {last}), t -> {iou_value} > t/{last}D))/{thresholds}D"


def letterbox(box: str, width: str, height: str, size: int) -> str:
    """Box of an image resized with its aspect kept and centred on a square canvas. Sizes round
    half to even, offsets down."""
    scale = f"least({size}D/{width}, {size}D/{height})"
    left = f"floor(({size} - greatest(1, int(bround({width}*{scale}))))/2D)"
    top = f"floor(({size} - greatest(1, int(bround({height}*{scale}))))/2D)"
    return (
        f"named_struct('x', {box}.x*{scale} + {left}, 'y', {box}.y*{scale} + {top},"
        f" 'w', {box}.w*{scale}, 'h', {box}.h*{scale})"
    )


def visible(box: str, least: float = 1.0) -> str:
    """Keeps boxes that are at least a pixel wide and high."""
    return f"({box}.w >= {least}D AND {box}.h >= {least}D)"
