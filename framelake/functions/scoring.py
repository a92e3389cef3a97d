"""Scores of faces and frames as column expressions.

Faces are structs; a frame's faces are an array of them. Missing scores are null, never NaN.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights and thresholds of the scores.
COMPOSITE_FACE_WEIGHT = 0.8
QUALITY_FACE_WEIGHT, QUALITY_AESTHETICS_WEIGHT, QUALITY_AREA_WEIGHT = 0.6, 0.3, 0.1
EXTRA_FACE_MIN, EXTRA_FACE_WEIGHT, EXTRA_FACE_CAP = 0.4, 0.15, 0.25
ZERO_FACE_CAP = 0.72
BUCKET_EDGES = ((0.35, "low"), (0.55, "medium"), (0.75, "high"))
TOP_BUCKET = "great"
LABELS = ("none", "bad", "okay", "good")
TOO_SMALL, SMALL_AT_EDGE, EDGE_BAND = 0.004, 0.025, 0.10
KEYPOINT_LOW, KEYPOINT_HIGH, KEYPOINT_SPAN = 0.25, 0.75, 0.25


def clamp(c: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    """Between lo and hi; null stays null."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(lo)), F.lit(hi)))


def no_nan(c: Column) -> Column:
    """NaN to null, so that no comparison meets it."""
    return F.when(~F.isnan(c), c)


def aesthetics_norm(raw: Column) -> Column:
    return clamp((raw - 1.0) / 9.0)


def composite(p_good: Column, aesthetics: Column, weight: float = COMPOSITE_FACE_WEIGHT) -> Column:
    """Weighted mean with the first face, the aesthetics alone where it has no score."""
    return F.coalesce(weight * p_good + (1 - weight) * aesthetics, aesthetics)


def face_score(p_okay: Column, p_good: Column) -> Column:
    """Half of okay and all of good; null only where both are."""
    return F.when(p_okay.isNotNull() | p_good.isNotNull(), clamp(0.5 * F.coalesce(p_okay, F.lit(0.0)) + F.coalesce(p_good, F.lit(0.0))))


def area_fraction(x1: Column, y1: Column, x2: Column, y2: Column, w: Column, h: Column) -> Column:
    """Share of the frame; null for a missing side or a frame without area."""
    side = lambda a, b: F.greatest(b - a, F.lit(0))
    whole = x1.isNotNull() & x2.isNotNull() & y1.isNotNull() & y2.isNotNull()
    return F.when(whole & (w > 0) & (h > 0), clamp(side(x1, x2).cast("double") * side(y1, y2) / (w.cast("double") * h)))


def face_quality(scores: Column) -> Column:
    """Best score of an array, with a capped bonus for further good faces; null without any."""
    best = F.array_max(scores)
    ranked = F.sort_array(F.filter(scores, lambda s: s.isNotNull()), asc=False)
    extra = F.aggregate(F.filter(F.slice(ranked, 2, 1000), lambda s: s >= EXTRA_FACE_MIN), F.lit(0.0), lambda a, s: a + EXTRA_FACE_WEIGHT * s)
    return F.when(best.isNotNull(), F.least(best + F.least(extra, F.lit(EXTRA_FACE_CAP)), F.lit(1.0)))


def best_slot_area(scores: Column, areas: Column) -> Column:
    """Area of the first face of the best score."""
    return F.get(areas, (F.array_position(scores, F.array_max(scores)) - 1).cast("int"))


def quality_score(scores: Column, areas: Column, aesthetics: Column, zero_face_cap: float = ZERO_FACE_CAP) -> Column:
    aes = clamp(F.coalesce(aesthetics, F.lit(0.0)))
    with_face = QUALITY_FACE_WEIGHT * face_quality(scores) + QUALITY_AESTHETICS_WEIGHT * aes + QUALITY_AREA_WEIGHT * F.coalesce(best_slot_area(scores, areas), F.lit(0.0))
    return clamp(F.coalesce(with_face, aes * zero_face_cap))


def bucket(score: Column, edges: tuple[tuple[float, str], ...] = BUCKET_EDGES, top: str = TOP_BUCKET) -> Column:
    """The first bucket whose upper edge is above the score; an edge belongs to the bucket above it."""
    out = F.when(score.isNull(), F.lit(None).cast("string"))
    for edge, name in edges:
        out = out.when(score < edge, name)
    return out.otherwise(top)


def predicted(probs: list[Column], labels: tuple[str, ...] = LABELS) -> tuple[Column, Column]:
    """Label of the highest probability, the first of equals, and that probability."""
    p = F.array(*probs)
    top = F.array_max(p)
    return F.get(F.array(*map(F.lit, labels)), (F.array_position(p, top) - 1).cast("int")), top


def best_pair(faces_p_good: Column) -> Column:
    """Mean of the first two, null unless both are scored."""
    return (F.get(faces_p_good, F.lit(0)) + F.get(faces_p_good, F.lit(1))) / 2.0


def rejection(x1: Column, y1: Column, x2: Column, y2: Column, w: Column, h: Column) -> Column:
    """Why a face is turned away: too small, or small with its centre in the outer band; null if it is not."""
    area = (x2 - x1).cast("double") * (y2 - y1) / (w.cast("double") * h)
    cx, cy = (x1 + x2) / 2.0, (y1 + y2) / 2.0
    at_edge = (cx < EDGE_BAND * w) | (cx > (1 - EDGE_BAND) * w) | (cy < EDGE_BAND * h) | (cy > (1 - EDGE_BAND) * h)
    return F.when(area < TOO_SMALL, F.format_string("too_small(%.4f<0.004)", area)).when((area < SMALL_AT_EDGE) & at_edge, F.format_string("small_and_edge(%.4f)", area))


def rejection_kind(reason: Column) -> Column:
    """The reason up to its bracket; whole where a bracket is missing or comes first."""
    return F.when(F.instr(reason, "(") > 1, F.substring_index(reason, "(", 1)).otherwise(reason)


def keypoint_anomalies(eye_y: Column, nose_y: Column, mouth_y: Column, eye_nose: Column, eye_mouth: Column, y_span: Column, box_h: Column, order_name: str = "order") -> Column:
    """Names of the geometric rules a face breaks; a rule without finite numbers is skipped."""
    ratio = F.try_divide(eye_nose, eye_mouth)
    span = F.try_divide(y_span, box_h)
    rules = [
        (~((eye_y < nose_y) & (nose_y < mouth_y)), order_name),
        (~ratio.between(KEYPOINT_LOW, KEYPOINT_HIGH), "ratio"),
        (span < KEYPOINT_SPAN, "span"),
    ]
    return F.filter(F.array(*[F.when(c, F.lit(n)) for c, n in rules]), lambda x: x.isNotNull())


def upright_label(degrees: Column, confidence: Column, least: float = 0.95) -> Column:
    """A turn worth showing, null otherwise."""
    return F.when(degrees.isin(90, 180, 270) & (confidence >= least), degrees)


def aesthetic_class(score: Column) -> Column:
    return F.when(score.isNull(), "none").when(score >= 8, "high").when(score >= 6, "mid").otherwise("low")


def identity_confidence(distance: Column) -> Column:
    return clamp(1.0 - distance)
