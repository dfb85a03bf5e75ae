"""Texel analytics: pictures and masks as tables of (texture_id, x, y).

Masks are either flag columns beside the texels or sparse (texture_id, x, y)
sets. Aggregations group by texture or block, so they combine map-side; window
partitions are pixel rows or columns, whose length is bounded by the texture.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arithmetic import clip, count_where, div, half_even
from ..functions.color import luminance, rgb_distance
from ..functions.ids import sha256_hex, tree_digest
from .words import (
    dilate_words,
    intersect_words,
    polygon_runs,
    rectangle_runs,
    run_words,
    subtract_words,
    texel_words,
    word_texels,
)

KEY = ["texture_id", "x", "y"]
RGBA = ["r", "g", "b", "a"]


# ---- comparing pictures ---------------------------------------------------


def paired(before: DataFrame, after: DataFrame, channels: list[str] = RGBA, how: str = "inner") -> DataFrame:
    """Both versions of each texel as ``b_*`` and ``a_*`` columns."""
    left = before.select(*KEY, *[F.col(c).alias(f"b_{c}") for c in channels])
    right = after.select(*KEY, *[F.col(c).alias(f"a_{c}") for c in channels])
    return left.join(right, KEY, how)


def any_differs(channels: list[str]) -> Column:
    out = F.lit(False)
    for c in channels:
        out = out | (F.col(f"b_{c}") != F.col(f"a_{c}"))
    return out


def change_measurements(pairs: DataFrame, flags: Column | None = None) -> DataFrame:
    """Changed texels and where they lie; ``pairs`` carries the mask flags."""
    changed = any_differs(["r", "g", "b"])
    return pairs.groupBy("texture_id").agg(
        F.count("*").alias("texels"),
        count_where(changed).alias("changed_pixels"),
        count_where(any_differs(["a"])).alias("changed_alpha"),
        count_where(changed & ~F.col("editable")).alias("changed_outside_editable"),
        count_where(changed & F.col("protected")).alias("changed_inside_protected"),
        count_where(changed & F.col("seam_guard")).alias("changed_inside_seam_guard"),
    )


def mask_violations(flags: DataFrame) -> DataFrame:
    f = F.col
    return flags.groupBy("texture_id").agg(
        count_where(f("old_text") & ~f("editable")).alias("old_text_outside"),
        count_where(f("new_text") & ~f("editable")).alias("new_text_outside"),
        count_where(f("editable") & f("protected")).alias("editable_protected"),
        count_where(f("seam_guard") & ~f("protected")).alias("seam_unprotected"),
        count_where(f("editable")).alias("editable_pixels"),
    )


def projection_invariants(pairs: DataFrame, selection: Column) -> DataFrame:
    """Changes outside a selection and alpha changes anywhere."""
    return pairs.groupBy("texture_id").agg(
        count_where((selection == 0) & any_differs(RGBA)).alias("outside_changes"),
        count_where(any_differs(["a"])).alias("alpha_changes"),
    )


def opaque_view_check(pairs: DataFrame) -> DataFrame:
    """An opaque working view keeps the source RGB and has alpha 255."""
    return pairs.groupBy("texture_id").agg(
        count_where(any_differs(["r", "g", "b"])).alias("rgb_changes"),
        count_where(F.col("a_a") != 255).alias("nonopaque_pixels"),
    )


def selection_subset(selection: DataFrame, allowed: DataFrame) -> DataFrame:
    """Selected texels outside the allowed mask, and whether any was dropped."""
    left = selection.select(*KEY, F.lit(1).alias("_s"))
    right = allowed.select(*KEY, F.lit(1).alias("_m"))
    return left.join(right, KEY, "full").groupBy("texture_id").agg(
        count_where(F.col("_s").isNotNull() & F.col("_m").isNull()).alias("outside_allowed"),
        count_where(F.col("_s").isNull() & F.col("_m").isNotNull()).alias("unselected_allowed"),
        (count_where(F.col("_s").isNull()) > 0).alias("reduced"),
    )


def pair_validation(pairs: DataFrame, edges: DataFrame, minimum_f1: float) -> DataFrame:
    """Alpha equality, changed fraction and the edge gate of an edited picture."""
    per = pairs.groupBy("texture_id").agg(
        (count_where(any_differs(["a"])) == 0).alias("alpha_equal"),
        F.round(F.avg(any_differs(["r", "g", "b"]).cast("double")), 8).alias("changed_fraction"),
    )
    structure = F.col("structure_f1").isNull() | (F.col("structure_f1") >= minimum_f1)
    return per.join(edges.select("texture_id", "structure_f1"), "texture_id", "left").select(
        "texture_id", "alpha_equal", "changed_fraction", "structure_f1",
        (F.col("alpha_equal") & (F.col("changed_fraction") > 0) & structure).alias("passed"),
    )


# ---- mask algebra ---------------------------------------------------------


def union_masks(*masks: DataFrame) -> DataFrame:
    out = masks[0].select(*KEY)
    for mask in masks[1:]:
        out = out.unionByName(mask.select(*KEY))
    return out.distinct()


def intersect_masks(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.select(*KEY).join(right.select(*KEY), KEY, "left_semi").distinct()


def subtract_masks(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.select(*KEY).join(right.select(*KEY), KEY, "left_anti").distinct()


def subset_violations(inner: DataFrame, outer: DataFrame) -> DataFrame:
    return subtract_masks(inner, outer).groupBy("texture_id").agg(F.count("*").alias("outside"))


def dilate(mask: DataFrame, radius: int, width: int, height: int) -> DataFrame:
    """Square dilation, clipped to the picture."""
    grown = dilate_words(texel_words(mask, ["texture_id"]), ["texture_id"], radius, width, height)
    return word_texels(grown, ["texture_id"]).select(*KEY)


def expand_blocks(texels: DataFrame, mask: DataFrame, block: int = 4) -> DataFrame:
    """Texels of every block that holds at least one mask texel."""
    bx, by = div(F.col("x"), block).alias("bx"), div(F.col("y"), block).alias("by")
    hit = mask.select("texture_id", bx, by).distinct()
    return texels.select(*KEY, bx, by).join(hit, ["texture_id", "bx", "by"], "left_semi").select(*KEY)


def shrink_mask(mask: DataFrame, factor: int) -> DataFrame:
    """Block union: a block is set if any of its texels is."""
    return mask.select(
        "texture_id", div(F.col("x"), factor).alias("x"), div(F.col("y"), factor).alias("y")
    ).distinct()


def pad_outside(texels: DataFrame, channels: list[str] = RGBA) -> DataFrame:
    """Fill uncovered texels with the nearest covered one.

    ``texels`` has a boolean ``covered``. The nearest covered texel of each
    pixel row is found with two windows; the column step then adds the row
    distance inside blocks of texture columns, whose size is bounded. Ties: smaller
    squared distance, then smaller y, then smaller x. The texels of a texture without any
    covered one have null sources and channels and the error ``no_coverage``.
    """
    row = Window.partitionBy("texture_id", "y").orderBy("x")
    here = F.when(F.col("covered"), F.col("x"))
    left = F.last(here, True).over(row.rowsBetween(Window.unboundedPreceding, 0))
    right = F.first(here, True).over(row.rowsBetween(0, Window.unboundedFollowing))
    near = F.when(
        left.isNull() | (right.isNotNull() & (right - F.col("x") < F.col("x") - left)), right
    ).otherwise(left)
    rows = texels.select(*KEY, near.alias("row_x"))

    def column_step(frame: pd.DataFrame) -> pd.DataFrame:
        y, x = frame["y"].to_numpy(np.int64), frame["x"].to_numpy(np.int64)
        top, left = y.min(), x.min()
        shape = (y.max() - top + 1, x.max() - left + 1)
        row_x = np.full(shape, -1, dtype=np.int64)
        row_x[y - top, x - left] = frame["row_x"].fillna(-1).to_numpy(np.int64)
        ys = np.arange(shape[0])[:, None] + top
        xs = np.arange(shape[1])[None, :] + left
        # two keys: squared distance, then y and x of the source (31 bits each)
        none = np.iinfo(np.int64).max
        tail = (ys << 31) | row_x
        flat = (row_x - xs) ** 2
        best, place = np.full(shape, none), np.full(shape, none)

        def nearer(into: slice, take: slice, step: int) -> None:
            far = np.where(row_x[take] >= 0, flat[take] + step * step, none)
            better = (far < best[into]) | ((far == best[into]) & (tail[take] < place[into]) & (far != none))
            np.copyto(best[into], far, where=better)
            np.copyto(place[into], tail[take], where=better)

        for step in range(shape[0] if (row_x >= 0).any() else 0):
            if step and step * step > best.max():
                break
            nearer(slice(step, None), slice(0, shape[0] - step), step)
            if step:
                nearer(slice(0, -step), slice(step, None), step)
        found = place[y - top, x - left]
        hit = found != none
        frame["source_y"] = pd.array(found >> 31, "Int64")
        frame["source_x"] = pd.array(found & 0x7FFFFFFF, "Int64")
        frame.loc[~hit, ["source_y", "source_x"]] = pd.NA
        return frame[["texture_id", "x", "y", "source_x", "source_y"]]

    # 64 columns of one texture per group: bounded by 64 times the texture height
    nearest = rows.groupBy("texture_id", div(F.col("x"), 64).alias("columns")).applyInPandas(
        column_step, "texture_id long, x long, y long, source_x long, source_y long"
    )
    colors = texels.select(
        "texture_id", F.col("x").alias("source_x"), F.col("y").alias("source_y"), *channels
    )
    error = F.when(F.col("source_x").isNull(), "no_coverage")
    return nearest.join(colors, ["texture_id", "source_x", "source_y"], "left").withColumn("error", error)


# ---- selections -----------------------------------------------------------


def color_condition(
    targets: list[list[float]] | None = None,
    tolerance: float = 0.0,
    reference: list[float] | None = None,
    distance: tuple[float | None, float | None] = (None, None),
    bounds: tuple[float | None, float | None] = (None, None),
) -> Column:
    """All given color conditions on r, g, b."""
    rgb = (F.col("r"), F.col("g"), F.col("b"))
    out = F.lit(True)
    if targets:
        nearest = [rgb_distance(*rgb, t) for t in targets]
        out = out & ((F.least(*nearest) if len(nearest) > 1 else nearest[0]) <= tolerance)
    for measured, (low, high) in (
        (rgb_distance(*rgb, reference) if reference else None, distance),
        (luminance(*rgb), bounds),
    ):
        if measured is None:
            continue
        if low is not None:
            out = out & (measured >= low)
        if high is not None:
            out = out & (measured <= high)
    return out


def in_rectangle(x0, y0, x1, y1) -> Column:
    return (F.col("x") >= x0) & (F.col("x") < x1) & (F.col("y") >= y0) & (F.col("y") < y1)


def in_annulus(cx, cy, inner, outer, start, end) -> Column:
    """Ring sector; a start angle above the end angle wraps around 360."""
    dx, dy = F.col("x") - cx, F.col("y") - cy
    radius = F.sqrt(dx * dx + dy * dy)
    angle = F.pmod(F.degrees(F.atan2(dy, dx)), F.lit(360.0))
    turn = F.when(start <= end, (angle >= start) & (angle <= end)).otherwise(
        (angle >= start) | (angle <= end)
    )
    return (radius >= inner) & (radius <= outer) & turn


def polygon_texels(texels: DataFrame, edges: DataFrame) -> DataFrame:
    """Texels inside closed polygons by the even-odd rule on texel centres.

    ``edges``: texture_id, polygon, x0, y0, x1, y1. Polygons become runs of pixel rows, so only the texels of a run are
    looked up.
    """
    keys = ["polygon", "texture_id"]
    inside = run_words(polygon_runs(edges, keys), keys)
    return word_texels(intersect_words(inside, texel_words(texels, ["texture_id"]), keys), keys).select("polygon", *KEY)


def recipe_selection(texels: DataFrame, regions: DataFrame, condition: Column, radius: int, seam: DataFrame, size: tuple[int, int]) -> DataFrame:
    """Region recipe: shape and color, dilated, clipped to the shape, minus seam.

    ``regions``: texture_id, region_id, x0, y0, x1, y1 (rectangles).
    """
    keys = ["texture_id", "region_id"]
    shapes = run_words(rectangle_runs(regions, keys), keys)
    fitting = texel_words(texels.filter(condition), ["texture_id"])
    grown = dilate_words(intersect_words(shapes, fitting, keys), keys, radius, *size)
    clipped = intersect_words(shapes, grown, keys)
    return word_texels(subtract_words(clipped, texel_words(seam, ["texture_id"]), keys), keys).select("region_id", *KEY)


def recipe_report(selected: DataFrame, regions: DataFrame, seam: DataFrame) -> DataFrame:
    """Pixels per region; empty selections and seam hits are violations."""
    on_seam = selected.join(seam.select(*KEY), KEY, "left_semi").groupBy("texture_id", "region_id").agg(F.count("*").alias("seam_hits"))
    counts = selected.groupBy("texture_id", "region_id").agg(F.count("*").alias("pixels"))
    keys = ["texture_id", "region_id"]
    joined = regions.select(*keys).join(counts, keys, "left").join(on_seam, keys, "left")
    return joined.select(
        *keys, F.coalesce("pixels", F.lit(0)).alias("pixels"),
        F.when(F.col("pixels").isNull(), "empty_selection").when(F.col("seam_hits") > 0, "seam_overlap").alias("violation"),
    )


# ---- layers ---------------------------------------------------------------


def compose_lettering(source: DataFrame, layers: DataFrame, editable: DataFrame) -> DataFrame:
    """Blend lettering layers (texture_id, region_id, x, y, r, g, b, a) on a source.

    Alpha stays the source's; nothing outside the editable mask changes.
    """
    top = layers.filter("a > 0").select(*KEY, *[F.col(c).alias(f"l_{c}") for c in RGBA])
    allowed = editable.select(*KEY, F.lit(True).alias("_ok"))
    joined = source.join(top, KEY, "left").join(allowed, KEY, "left")
    share = F.col("l_a") / 255.0

    def blended(c: str) -> Column:
        mixed = clip(half_even(F.col(f"l_{c}") * share + F.col(c) * (1.0 - share)), 0, 255)
        return F.when(F.col("_ok") & F.col("l_a").isNotNull(), mixed).otherwise(F.col(c)).alias(c)

    return joined.select(*KEY, *[blended(c) for c in "rgb"], "a")


def layer_report(layers: DataFrame, new_text: DataFrame) -> DataFrame:
    """Overlaps between regions and differences to the new-text mask."""
    covered = layers.filter("a > 0").groupBy(*KEY).agg(F.count("*").alias("n"))
    mask = new_text.select(*KEY, F.lit(1).alias("_m"))
    return covered.join(mask, KEY, "full").groupBy("texture_id").agg(
        count_where(F.col("n") > 1).alias("overlapping_texels"),
        count_where(F.col("n").isNotNull() & F.col("_m").isNull()).alias("outside_new_text"),
        count_where(F.col("n").isNull()).alias("missing_texels"),
    )


def master_alpha(layers: DataFrame, masks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Union of region alphas, and a report per region.

    ``layers``: texture_id, region_id, x, y, a; ``masks``: texture_id, region_id, x, y.
    """
    visible = layers.filter("a > 0")
    union = visible.groupBy(*KEY).agg(F.max("a").alias("a"), F.count("*").alias("n"))
    keys = ["texture_id", "region_id"]
    shared = visible.join(union.filter("n > 1").select(*KEY), KEY, "left_semi").groupBy(*keys).agg(F.count("*").alias("overlaps"))
    support = visible.select("region_id", *KEY, F.lit(1).alias("_v")).join(
        masks.select("region_id", *KEY, F.lit(1).alias("_m")), ["region_id", *KEY], "full"
    )
    per = support.groupBy(*keys).agg(
        count_where(F.col("_v").isNotNull()).alias("support"),
        count_where(F.col("_v").isNull() | F.col("_m").isNull()).alias("support_mismatch"),
    )
    report = per.join(shared, keys, "left").withColumn("overlaps", F.coalesce("overlaps", F.lit(0)))
    return union.select(*KEY, "a"), report


def restore_patch(texels: DataFrame, patch: DataFrame, mask: DataFrame, channels: list[str]) -> DataFrame:
    """Selected channels inside the mask are taken from the patch."""
    spare = patch.select(*KEY, *[F.col(c).alias(f"p_{c}") for c in channels]).join(mask.select(*KEY), KEY, "left_semi")
    return texels.join(spare, KEY, "left").select(
        *KEY, *[F.coalesce(f"p_{c}", c).alias(c) if c in channels else F.col(c) for c in RGBA]
    )


def neutralization_metrics(pairs: DataFrame, inside: Column, selected: list[str]) -> DataFrame:
    """Changed texels, changes outside the mask and in unselected channels."""
    changed = any_differs(RGBA)
    others = [c for c in RGBA if c not in selected]
    wrong = sum(((F.col(f"b_{c}") != F.col(f"a_{c}")).cast("int") for c in others), F.lit(0))
    return pairs.groupBy("texture_id").agg(
        count_where(changed).alias("changed_pixels"),
        count_where(changed & ~inside).alias("changed_outside_mask"),
        F.sum(wrong).alias("changed_unselected_channels"),
    )


def masked_layer(texels: DataFrame, selectedness: Column) -> DataFrame:
    """RGB is zero outside the selection; alpha is scaled with half-up rounding."""
    on = selectedness > 0
    alpha = div(F.col("a") * selectedness + 127, 255)
    return texels.select(
        *KEY,
        *[F.when(on, F.col(c)).otherwise(F.lit(0).cast("long")).alias(c) for c in "rgb"],
        F.when(on, alpha).otherwise(F.lit(0).cast("long")).alias("a"),
    )


# ---- picture statistics ---------------------------------------------------


def texture_class(texels: DataFrame) -> DataFrame:
    """Normal, gloss or diffuse by channel statistics."""
    stats = texels.groupBy("texture_id").agg(
        F.min("r").alias("lo"), F.max("r").alias("hi"),
        (F.avg(F.abs(F.col("r") - F.col("g"))) + F.avg(F.abs(F.col("g") - F.col("b")))).alias("spread"),
        F.avg("a").alias("opacity"),
    )
    kind = (
        F.when((F.col("lo") == 255) & (F.col("hi") == 255), "N")
        .when((F.col("spread") < 6) & (F.col("opacity") > 250), "G")
        .otherwise("D")
    )
    return stats.select("texture_id", kind.alias("texture_class"))


def otsu_threshold(texels: DataFrame, value: str) -> DataFrame:
    """Threshold with the largest between-class variance; the first best wins.

    Windows run over at most 256 histogram bins per texture.
    """
    bins = texels.groupBy("texture_id", F.col(value).alias("bin")).agg(F.count("*").alias("n"))
    run = Window.partitionBy("texture_id").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("texture_id")
    w, total = F.sum("n").over(run), F.sum("n").over(whole)
    s, grand = F.sum(F.col("n") * F.col("bin")).over(run), F.sum(F.col("n") * F.col("bin")).over(whole)
    scored = bins.select("texture_id", "bin", w.alias("w"), total.alias("t"), s.alias("s"), grand.alias("g"))
    gap = F.col("s") / F.col("w") - (F.col("g") - F.col("s")) / (F.col("t") - F.col("w"))
    variance = F.round(F.col("w") * (F.col("t") - F.col("w")) * gap * gap, 6)
    open_bins = scored.filter((F.col("w") < F.col("t")) & (F.col("bin") < 255)).withColumn("v", variance)
    best = open_bins.groupBy("texture_id").agg(F.max(F.struct("v", (-F.col("bin")).alias("back"))).alias("m"))
    ids = bins.select("texture_id").distinct()
    return ids.join(best, "texture_id", "left").select(
        "texture_id", F.coalesce(-F.col("m.back"), F.lit(127)).alias("threshold")
    )


def running_histogram(texels: DataFrame, value: str) -> DataFrame:
    """Cumulative weight and sum per histogram bin."""
    bins = texels.groupBy("texture_id", F.col(value).alias("bin")).agg(F.count("*").alias("n"))
    run = Window.partitionBy("texture_id").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    return bins.select(
        "texture_id", "bin", F.sum("n").over(run).alias("weight"), F.sum(F.col("n") * F.col("bin")).over(run).alias("weighted_sum")
    )


def sobel_edges(texels: DataFrame, channel: Column) -> DataFrame:
    """Interior texels whose gradient exceeds the texture's 85th percentile.

    The threshold is at least 8. Neighbours come from one shuffle by texel.
    """
    shifts = F.explode(F.array(*[
        F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)
    ]))
    spread = texels.select(*KEY, channel.alias("v")).withColumn("s", shifts).select(
        "texture_id", (F.col("x") + F.col("s.dx")).alias("x"), (F.col("y") + F.col("s.dy")).alias("y"),
        (-F.col("s.dx") * (2 - F.abs(F.col("s.dy"))) * F.col("v")).alias("px"),
        (-F.col("s.dy") * (2 - F.abs(F.col("s.dx"))) * F.col("v")).alias("py"),
    )
    grad = spread.groupBy(*KEY).agg(F.sum("px").alias("gx"), F.sum("py").alias("gy"), F.count("*").alias("n")).filter("n = 9")
    sized = grad.select(*KEY, F.round(F.sqrt(F.col("gx") ** 2 + F.col("gy") ** 2), 6).alias("m"))
    # 8-bit gray gives few distinct magnitudes, so the exact percentile stays small
    level = sized.filter("m > 0").groupBy("texture_id").agg(F.greatest(F.lit(8.0), F.percentile("m", 0.85)).alias("high"))
    return sized.join(level, "texture_id").filter("m >= high").select(*KEY)


def edge_overlap(before: DataFrame, after: DataFrame, size: tuple[int, int], minimum: int = 32) -> DataFrame:
    """Retention, alignment and F1 of two edge sets within a 5x5 neighbourhood."""
    near_before, near_after = dilate(before, 2, *size), dilate(after, 2, *size)
    kept = before.join(near_after, KEY, "left_semi").groupBy("texture_id").agg(F.count("*").alias("kept"))
    aligned = after.join(near_before, KEY, "left_semi").groupBy("texture_id").agg(F.count("*").alias("aligned"))
    counts = before.groupBy("texture_id").agg(F.count("*").alias("source_edges")).join(
        after.groupBy("texture_id").agg(F.count("*").alias("edited_edges")), "texture_id", "full"
    )
    joined = counts.join(kept, "texture_id", "left").join(aligned, "texture_id", "left").fillna(0)
    enough = F.least("source_edges", "edited_edges") >= minimum
    retention = F.when(enough, F.col("kept") / F.col("source_edges"))
    alignment = F.when(enough, F.col("aligned") / F.col("edited_edges"))
    total = retention + alignment
    f1 = F.when(total > 0, 2 * retention * alignment / total).when(enough, 0.0)
    return joined.select(
        "texture_id", "source_edges", "edited_edges",
        F.round(retention, 8).alias("retention"), F.round(alignment, 8).alias("alignment"), F.round(f1, 8).alias("structure_f1"),
    )


def roundtrip_limits(role: str, side: Column, max_mae: float = 6.0) -> tuple[Column, Column, Column]:
    """Calibrated MAE, p99 and maximum limits by role and size."""
    base, p99 = F.lit(max_mae), F.lit(max(64.0, max_mae * 8.0))
    if role == "diffuse":
        floor = (
            F.when(side == 4, 24.0).when(side <= 2, 16.0).when(side <= 16, 16.0)
            .when(side <= 32, 12.0).when(side <= 64, 8.0).otherwise(0.0)
        )
        return F.greatest(base, floor), F.when(side <= 32, F.greatest(p99, F.lit(80.0))).otherwise(p99), F.lit(128.0)
    if role == "gloss":
        return F.when(side == 8, F.greatest(base, F.lit(8.0))).otherwise(base), p99, F.lit(128.0)
    return base, p99, F.lit(128.0)


def roundtrip_errors(pairs: DataFrame, role: str, max_mae: float = 6.0) -> DataFrame:
    """Error statistics per texture and channel against the limits."""
    errors = {c: F.abs(F.col(f"b_{c}") - F.col(f"a_{c}")) for c in RGBA}
    # at most 256 distinct errors: the exact percentile state is bounded
    per = pairs.groupBy("texture_id").agg(
        F.least(F.max("x") + 1, F.max("y") + 1).alias("side"),
        *[
            F.struct(
                F.lit(c).alias("channel"), F.round(F.avg(e), 6).alias("mae"),
                F.percentile(e, F.array(F.lit(0.95), F.lit(0.99))).alias("p"), F.max(e).alias("maximum"),
            ).alias(c)
            for c, e in errors.items()
        ],
    )
    mae, p99, top = roundtrip_limits(role, F.col("side"), max_mae)
    return (
        per.select("texture_id", "side", F.explode(F.array(*RGBA)).alias("s"))
        .select("texture_id", "side", "s.channel", "s.mae", F.round(F.col("s.p")[0], 6).alias("p95"), F.round(F.col("s.p")[1], 6).alias("p99"), "s.maximum")
        .withColumn("within_limits", (F.col("mae") <= mae) & (F.col("p99") <= p99) & (F.col("maximum") <= top))
    )


def payload_size(width: Column, height: Column, block_bytes: int = 16) -> Column:
    """Bytes of a block-compressed mip chain down to 1x1."""
    levels = F.sequence(F.lit(0), F.floor(F.log2(F.greatest(width, height).cast("double")) + 1e-9).cast("int"))

    def size(total: Column, level: Column) -> Column:
        w = F.greatest(F.call_function("shiftright", width, level), F.lit(1))
        h = F.greatest(F.call_function("shiftright", height, level), F.lit(1))
        return total + div(w + 3, 4) * div(h + 3, 4) * block_bytes

    return F.aggregate(levels, F.lit(0).cast("long"), size)


def panel_boxes(boxes: DataFrame, padding: int, width: int, height: int) -> DataFrame:
    """Union box of a panel's regions, padded and clipped."""
    return boxes.groupBy("panel").agg(
        F.greatest(F.lit(0), F.min("x0") - padding).alias("x0"), F.greatest(F.lit(0), F.min("y0") - padding).alias("y0"),
        F.least(F.lit(width), F.max("x1") + padding).alias("x1"), F.least(F.lit(height), F.max("y1") + padding).alias("y1"),
    )


def context_crop(boxes: DataFrame, padding: int, width: int, height: int) -> DataFrame:
    """Square context crop around a box when the canvas allows one."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    side = F.greatest(w, h) + padding * 2
    fits = side <= min(width, height)
    sx = clip(F.bround(F.col("x0") + w / 2 - side / 2).cast("long"), F.lit(0), F.lit(width) - side)
    sy = clip(F.bround(F.col("y0") + h / 2 - side / 2).cast("long"), F.lit(0), F.lit(height) - side)
    ex0, ey0 = F.greatest(F.lit(0), F.col("x0") - padding), F.greatest(F.lit(0), F.col("y0") - padding)
    ex1, ey1 = F.least(F.lit(width), F.col("x1") + padding), F.least(F.lit(height), F.col("y1") + padding)
    return boxes.select(
        "panel",
        F.when(fits, sx).otherwise(ex0).alias("crop_x"), F.when(fits, sy).otherwise(ey0).alias("crop_y"),
        F.when(fits, side).otherwise(ex1 - ex0).alias("crop_w"), F.when(fits, side).otherwise(ey1 - ey0).alias("crop_h"),
    )


def foreign_triage(detections: DataFrame, ratios: DataFrame, expected: DataFrame, preserved: DataFrame) -> DataFrame:
    """Classify foreign readings in the editable area.

    ``detections``: texture_id, box_id, key, foreign; ``ratios``: box_id,
    editable, old_text, new_text; ``expected``/``preserved``: texture_id, key.
    Readings are reduced to the distinct keys of a texture before they meet the
    few texts expected on it.
    """
    inside = detections.filter("foreign").join(ratios, "box_id").filter("editable > 0.05")
    pair = ["texture_id", "key"]
    keys = inside.select(*pair).filter("key <> ''").distinct()
    named = keys.join(preserved.select(*pair).distinct(), pair, "left_semi")
    wanted = expected.select("texture_id", F.col("key").alias("want")).distinct()
    contained = (
        keys.join(wanted, "texture_id")
        .filter(F.contains("want", "key") | F.contains("key", "want"))
        .select(*pair)
    )
    allowed = named.unionByName(contained).distinct().withColumn("_ok", F.lit(True))
    verdict = (
        F.when(F.col("_ok"), "allowed")
        .when((F.col("new_text") > 0.05) | (F.col("old_text") > 0.05), "ambiguous")
        .otherwise("foreign")
    )
    return inside.join(allowed, pair, "left").withColumn("verdict", verdict).drop("_ok")


def half_up_mean(total: Column, area: int) -> Column:
    return div(total + area // 2, area)


def project_alpha(texels: DataFrame, factor: int) -> DataFrame:
    """Exact block mean of alpha with integer half-up rounding."""
    return texels.groupBy("texture_id", div(F.col("x"), factor).alias("x"), div(F.col("y"), factor).alias("y")).agg(
        half_up_mean(F.sum("a"), factor * factor).alias("a")
    )


def power_of_two_shrink(w: Column, h: Column, tw: Column, th: Column) -> Column:
    """Whether one size is a 2^n integer shrink of the other."""
    whole = (F.pmod(w, tw) == 0) & (F.pmod(h, th) == 0)
    factor = div(w, tw)
    return whole & (factor == div(h, th)) & (F.bit_count(factor) == 1)


def alignment(source: DataFrame, projected: DataFrame, factor: int) -> DataFrame:
    """Centroid and box errors of a projected alpha, in target texels."""

    def geometry(df: DataFrame, prefix: str, width: Column, height: Column) -> DataFrame:
        on = F.col("a") > 0
        total = F.sum("a")
        return df.groupBy("texture_id").agg(
            (F.sum((F.col("x") + 0.5) * F.col("a")) / total).alias(f"{prefix}_cx"),
            (F.sum((F.col("y") + 0.5) * F.col("a")) / total).alias(f"{prefix}_cy"),
            F.min(F.when(on, F.col("x"))).alias(f"{prefix}_x0"), F.min(F.when(on, F.col("y"))).alias(f"{prefix}_y0"),
            (F.max(F.when(on, F.col("x"))) + 1).alias(f"{prefix}_x1"), (F.max(F.when(on, F.col("y"))) + 1).alias(f"{prefix}_y1"),
            total.alias(f"{prefix}_sum"),
        )

    s = geometry(source, "s", None, None)
    p = geometry(projected, "p", None, None)
    centre = F.greatest(*[F.abs(F.col(f"s_c{c}") / factor - F.col(f"p_c{c}")) for c in "xy"])
    edge = F.greatest(*[F.abs(F.col(f"p_{c}") - F.col(f"s_{c}") / factor) for c in ("x0", "y0", "x1", "y1")])
    return s.join(p, "texture_id").select(
        "texture_id", F.round(centre, 6).alias("center_error_texels"), F.round(edge, 6).alias("bbox_edge_error_texels"),
        F.col("s_sum").alias("source_coverage_sum"), F.col("p_sum").alias("projected_coverage_sum"),
    )


def texel_digest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Order-independent digest of the texels of each key."""
    body = F.concat_ws(",", *[c for c in rows.columns if c not in keys])
    return tree_digest(rows, keys, sha256_hex(body)).select(*keys, "digest")


