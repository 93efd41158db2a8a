"""Box, keypoint and frame geometry as Column expressions (no UDF, all inside codegen)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from framelake.schemas import SKELETON

Box = tuple[Column, Column, Column, Column]


def field_box(s: Column) -> Box:
    """cx, cy, w, h of a struct."""
    return s["cx"], s["cy"], s["w"], s["h"]


def cxcywh_to_xyxy(cx: Column, cy: Column, w: Column, h: Column) -> Box:
    return cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2


def xyxy_to_cxcywh(x1: Column, y1: Column, x2: Column, y2: Column) -> Box:
    """Sizes are never negative."""
    zero = F.lit(0.0)
    return (x1 + x2) / 2, (y1 + y2) / 2, F.greatest(zero, x2 - x1), F.greatest(zero, y2 - y1)


def area(w: Column, h: Column, clamp: bool = False) -> Column:
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h) if clamp else w * h


def iou(a: Box, b: Box, eps: float = 0.0) -> Column:
    """Intersection over union of two centre boxes; 0 where the union is not positive or not a number."""
    ax1, ay1, ax2, ay2 = cxcywh_to_xyxy(*a)
    bx1, by1, bx2, by2 = cxcywh_to_xyxy(*b)
    zero = F.lit(0.0)
    inter = F.greatest(zero, F.least(ax2, bx2) - F.greatest(ax1, bx1)) * F.greatest(zero, F.least(ay2, by2) - F.greatest(ay1, by1))
    union = a[2] * a[3] + b[2] * b[3] - inter
    if eps:
        return inter / (union + F.lit(eps))
    return F.when(F.isnan(union) | (union <= 0), 0.0).otherwise(inter / F.when(union > 0, union))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def letterbox(ow: Column, oh: Column, width: Column, height: Column) -> tuple[Column, Column, Column, Column, Column]:
    """Forward pass: scale, scaled size (truncated), integer padding."""
    scale = F.least(width / ow, height / oh)
    nw, nh = (ow * scale).cast("int"), (oh * scale).cast("int")
    return scale, nw, nh, F.floor((width - nw) / 2).cast("int"), F.floor((height - nh) / 2).cast("int")


def to_original(box: Box, ow: Column, oh: Column, width: Column, height: Column, dx: Column | None = None, dy: Column | None = None, tw: Column | None = None, th: Column | None = None, geometry: str = "native") -> Box:
    """Boxes of a letterboxed input in pixels of the frame.

    ``native``: float padding, offset of the crop, centre and size clamped to the frame
    (unknown size: 999999); ``corner``: corners clamped to the frame, then re-centred; ``int``:
    integer padding, corners truncated and clamped. Unknown dimensions (<= 0) leave a box as it is.
    """
    cx, cy, w, h = box
    scale = F.least(width / ow, height / oh)
    known = (ow > 0) & (oh > 0)
    scale = F.when(known, scale)
    zero = F.lit(0.0)
    clamp = lambda v, hi: F.least(F.greatest(v, zero), hi)
    if geometry == "native":
        px, py = (width - ow * scale) / 2, (height - oh * scale) / 2
        mx, my = (F.when(t > 0, t).otherwise(999999.0) if t is not None else F.lit(999999.0) for t in (tw, th))
        new = [clamp((cx - px) / scale + (dx if dx is not None else 0), mx), clamp((cy - py) / scale + (dy if dy is not None else 0), my), clamp(w / scale, mx), clamp(h / scale, my)]
    else:
        x1, y1, x2, y2 = cxcywh_to_xyxy(*box)
        if geometry == "corner":
            px, py, cut = (width - ow * scale) / 2, (height - oh * scale) / 2, lambda v: v
        elif geometry == "int":
            px, py = (((d - (o * scale).cast("int")).cast("int") / 2).cast("int") for d, o in ((width, ow), (height, oh)))
            cut = lambda v: v.cast("int").cast("double")
        else:
            raise ValueError(f"geometry: {geometry}")
        x1, x2 = (clamp(cut((v - px) / scale), ow.cast("double")) for v in (x1, x2))
        y1, y2 = (clamp(cut((v - py) / scale), oh.cast("double")) for v in (y1, y2))
        new = list(xyxy_to_cxcywh(x1, y1, x2, y2))
    return tuple(F.when(known, n).otherwise(o) for n, o in zip(new, box, strict=True))


def roi_pixels(roi: Column, width: Column, height: Column) -> Box:
    """Corners in whole pixels, the second at least one after the first."""
    x1 = F.least(F.greatest((roi["x1"] * width).cast("int"), F.lit(0)), width - 1)
    y1 = F.least(F.greatest((roi["y1"] * height).cast("int"), F.lit(0)), height - 1)
    x2 = F.least(F.greatest((roi["x2"] * width).cast("int"), x1 + 1), width)
    y2 = F.least(F.greatest((roi["y2"] * height).cast("int"), y1 + 1), height)
    return x1, y1, x2, y2


def valid_roi(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    inside = [c.between(0, 1) for c in (x1, y1, x2, y2)]
    return inside[0] & inside[1] & inside[2] & inside[3] & (x1 < x2) & (y1 < y2)


def draw_box(box: Box, width: Column, height: Column) -> Box:
    """Corners to draw: boxes with all values up to 1 are taken as normalised; truncated and clamped."""
    cx, cy, w, h = box
    norm = (cx <= 1) & (cy <= 1) & (w <= 1) & (h <= 1)
    x1, y1, x2, y2 = cxcywh_to_xyxy(*(F.when(norm, v * s).otherwise(v) for v, s in zip(box, (width, height, width, height), strict=True)))
    cut = lambda v, hi: F.least(F.greatest(v.cast("int"), F.lit(0)), hi - 1)
    return cut(x1, width), cut(y1, height), cut(x2, width), cut(y2, height)


def box_label(class_id: Column, confidence: Column) -> Column:
    return F.format_string("Class %d (%d%%)", class_id, (confidence * 100).cast("int"))


def palette_index(class_id: Column) -> Column:
    return F.pmod(class_id, F.lit(8))


def keypoint_confidence(c: Column) -> Column:
    """Values above 1 are bytes."""
    return F.when(c > 1, F.least(F.lit(1.0), F.greatest(F.lit(0.0), c / 255))).otherwise(c)


def visible(keypoints: Column, threshold: float = 0.1) -> Column:
    return F.filter(keypoints, lambda k: k["confidence"] > threshold)


def skeleton_segments(keypoints: Column, threshold: float = 0.1) -> Column:
    """Array of (a, b, x1, y1, x2, y2) for edges whose ends are both visible."""
    edges = []
    for a, b in SKELETON:
        p, q = F.get(keypoints, F.lit(a)), F.get(keypoints, F.lit(b))
        both = (p["confidence"] > threshold) & (q["confidence"] > threshold)
        edges.append(F.when(both, F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2"))))
    return F.filter(F.array(*edges), lambda e: e.isNotNull())


def _in_frame(k: Column, width: Column, height: Column) -> Column:
    """Whether a keypoint's whole pixel lies inside the frame."""
    x, y = k["x"].cast("int"), k["y"].cast("int")
    return (x >= 0) & (x < width) & (y >= 0) & (y < height)


def drawn_points(keypoints: Column, width: Column, height: Column, threshold: float = 0.3) -> Column:
    """Array of (k, x, y) in whole pixels: visible keypoints inside the frame."""
    at = F.transform(keypoints, lambda p, i: F.struct(i.cast("long").alias("k"), p["x"].cast("int").alias("x"), p["y"].cast("int").alias("y"), ((p["confidence"] > threshold) & _in_frame(p, width, height)).alias("seen")))
    return F.transform(F.filter(at, lambda p: p["seen"]), lambda p: F.struct(p["k"], p["x"], p["y"]))


def drawn_segments(keypoints: Column, width: Column, height: Column, threshold: float = 0.3) -> Column:
    """Like skeleton_segments, in whole pixels, for edges whose ends both lie inside the frame."""
    inside = lambda e: (e["x1"].between(0, width - 1)) & (e["y1"].between(0, height - 1)) & (e["x2"].between(0, width - 1)) & (e["y2"].between(0, height - 1))
    whole = F.transform(skeleton_segments(keypoints, threshold), lambda e: F.struct(e["a"], e["b"], *(e[c].cast("int").alias(c) for c in ("x1", "y1", "x2", "y2"))))
    return F.filter(whole, inside)


def box_diagnostics(cx: Column, cy: Column, w: Column, h: Column, conf: Column) -> dict[str, Column]:
    """Flags for looking into odd boxes; nothing is dropped by them."""
    unit = cx.between(0, 1) & cy.between(0, 1) & w.between(0, 1) & h.between(0, 1)
    return {
        "is_normalised": unit, "is_pixel_like": (cx > 100) | (cy > 100) | (w > 100) | (h > 100), "conf_in_range": conf.between(0, 1), "is_invalid": (w <= 0) | (h <= 0),
        "full_hd_x": F.when(unit, cx * 1920).otherwise(cx), "full_hd_y": F.when(unit, cy * 1080).otherwise(cy),
    }
