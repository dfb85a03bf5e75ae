"""Mip levels and derived maps."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arithmetic import clip, count_where, div, half_even, half_up
from ..functions.color import (
    blend_normals,
    decode_normal,
    linear_to_srgb,
    pack_axis,
    pack_normal,
    packed_length,
    srgb_to_linear,
    unpack_axis,
)
from .texels import KEY, RGBA, any_differs, pad_outside, paired

#: Fixed value: least z of a blended normal.
MINIMUM_Z = 0.05


def picture_sizes(texels: DataFrame) -> DataFrame:
    """Width and height of every picture, from its outermost texels."""
    return texels.groupBy("texture_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))


def with_sizes(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    return rows.join(sizes.select("texture_id", "width", "height"), "texture_id")


def _halved(size: Column) -> Column:
    return F.greatest(F.lit(1), div(size, 2)).cast("long")


def _shares(place: Column, size: Column) -> Column:
    """Where a texel of an axis goes one level down, as (at, part) rows.

    The axis is measured in units of 1 / (size * target size): a texel covers ``target size`` units, a target texel
    ``size`` units, so a texel lies in one target or, at odd sizes, is split over two by its overlap.
    """
    units = _halved(size)
    start = place * units
    first = div(start, size)
    part = F.least(units, (first + 1) * size - start)
    here = F.struct(first.alias("at"), part.alias("part"))
    split = F.array(here, F.struct((first + 1).alias("at"), (units - part).alias("part")))
    return F.when(part == units, F.array(here)).otherwise(split)


def shrunk_shares(rows: DataFrame) -> DataFrame:
    """Rows with x, y, width and height moved to the next level; ``area`` is the share of the target's width * height units."""
    others = [c for c in rows.columns if c not in ("x", "y", "width", "height")]
    across = rows.withColumn("_x", F.explode(_shares(F.col("x"), F.col("width"))))
    both = across.withColumn("_y", F.explode(_shares(F.col("y"), F.col("height"))))
    return both.select(
        *others, F.col("_x.at").alias("x"), F.col("_y.at").alias("y"), "width", "height",
        (F.col("_x.part") * F.col("_y.part")).alias("area"),
    )


def _area_means(texels: DataFrame, **values: Column) -> DataFrame:
    """Area-weighted means per target texel; one shuffle by target texel with map-side sums."""
    rows = shrunk_shares(texels.select(*KEY, "width", "height", *[v.alias(k) for k, v in values.items()]))
    area = F.sum("area")
    means = rows.groupBy(*KEY, "width", "height").agg(*[(F.sum(F.col(k) * F.col("area")) / area).alias(k) for k in values])
    return means.withColumns({"width": _halved(F.col("width")), "height": _halved(F.col("height"))})


def _byte(value: Column) -> Column:
    return clip(half_even(value), 0, 255)


def sized_level(texels: DataFrame, role: str) -> DataFrame:
    """One mip step of texels that carry width and height; so does the result."""
    rest = ["width", "height"]
    if role == "gloss":
        means = _area_means(texels, **{c: F.col(c) for c in RGBA})
        return means.select(*KEY, *[_byte(F.col(c)).alias(c) for c in RGBA], *rest)
    if role == "diffuse":
        means = _area_means(texels, **{c: srgb_to_linear(F.col(c)) for c in "rgb"}, a=F.col("a"))
        return means.select(*KEY, *[linear_to_srgb(F.col(c)).alias(c) for c in "rgb"], _byte(F.col("a")).alias("a"), *rest)
    if role == "normal":
        x, y = unpack_axis(F.col("a")), unpack_axis(F.col("g"))
        z = F.sqrt(clip(1.0 - x * x - y * y, 0.0, 1.0))
        means = _area_means(texels, nx=x, ny=y, nz=z, mr=F.col("r"), mb=F.col("b"))
        size = F.greatest(F.sqrt(F.col("nx") ** 2 + F.col("ny") ** 2 + F.col("nz") ** 2), F.lit(1e-8))
        px, py = pack_normal(F.col("nx") / size, F.col("ny") / size)
        return means.select(*KEY, _byte(F.col("mr")).alias("r"), py.alias("g"), _byte(F.col("mb")).alias("b"), px.alias("a"), *rest)
    raise ValueError(f"unknown texture role: {role}")


def next_level(texels: DataFrame, role: str, sizes: DataFrame | None = None) -> DataFrame:
    """One mip step: every axis of n texels becomes max(1, n div 2), each texel counted by the area it shares.

    ``sizes``: texture_id, width, height where they are known; else they are taken from the texels.
    """
    sized = with_sizes(texels, picture_sizes(texels) if sizes is None else sizes)
    return sized_level(sized, role).select(*KEY, *RGBA)


def mip_chain(texels: DataFrame, role: str, levels: int, sizes: DataFrame | None = None, coverage: DataFrame | None = None) -> DataFrame:
    """All levels; each step reads the rounded level above it.

    With ``coverage`` (texture_id, x, y of the covered texels) uncovered texels are filled from the nearest covered one
    before and after every step, but level 0 is returned as it is. The coverage of a level is ``mask_chain``'s.
    """
    if levels < 1:
        raise ValueError("a mip chain has one level at least")
    if role not in ("gloss", "diffuse", "normal"):
        raise ValueError(f"unknown texture role: {role}")
    current = texels.select(*KEY, *RGBA)
    sizes = picture_sizes(current) if sizes is None else sizes
    masks = None if coverage is None else mask_chain(coverage, levels, sizes)
    out = current.withColumn("level", F.lit(0))
    current = with_sizes(current, sizes)
    for level in range(1, levels):
        if masks is not None:
            current = _filled(current, masks.filter(F.col("level") == level - 1), sizes)
        current = sized_level(current, role)
        sizes = sizes.select("texture_id", *[_halved(F.col(c)).alias(c) for c in ("width", "height")])
        if masks is not None:
            current = _filled(current, masks.filter(F.col("level") == level), sizes)
        out = out.unionByName(current.select(*KEY, *RGBA).withColumn("level", F.lit(level)))
    return out


def _filled(texels: DataFrame, covered: DataFrame, sizes: DataFrame) -> DataFrame:
    marked = texels.join(covered.select(*KEY, F.lit(True).alias("covered")), KEY, "left").fillna(False, ["covered"])
    return with_sizes(pad_outside(marked, RGBA).select(*KEY, *RGBA), sizes)


def mask_chain(mask: DataFrame, levels: int, sizes: DataFrame) -> DataFrame:
    """All levels of a mask; each step reads the level above it.

    A target texel is set if the set texels share more than 1/510 of its area, the smallest share that an eight-bit
    average shows. At even sizes that is any texel of the block.
    """
    current = mask.select(*KEY).distinct()
    out = current.withColumn("level", F.lit(0))
    current = with_sizes(current, sizes)
    for level in range(1, levels):
        shares = shrunk_shares(current).groupBy(*KEY, "width", "height").agg(F.sum("area").alias("area"))
        current = shares.filter(510 * F.col("area") > F.col("width") * F.col("height")).select(
            *KEY, _halved(F.col("width")).alias("width"), _halved(F.col("height")).alias("height")
        )
        out = out.unionByName(current.select(*KEY).withColumn("level", F.lit(level)))
    return out


def level_changes(before: DataFrame, after: DataFrame, flags: DataFrame, selected: list[str]) -> DataFrame:
    """Invariants per level before compression.

    ``before``/``after``: mip chains; ``flags``: texture_id, level, x, y with
    effect, guarded, covered. Level 0 is checked everywhere, deeper levels only
    where covered; below level 0 a guarded texel may change inside an effect.
    """
    keys = ["texture_id", "level", "x", "y"]
    b = before.select(*keys, *[F.col(c).alias(f"b_{c}") for c in RGBA])
    a = after.select(*keys, *[F.col(c).alias(f"a_{c}") for c in RGBA])
    rows = b.join(a, keys).join(flags, keys)
    changed = any_differs(RGBA)
    domain = (F.col("level") == 0) | F.col("covered")
    guarded = changed & F.col("guarded") & ((F.col("level") == 0) | ~F.col("effect"))
    return rows.groupBy("texture_id", "level").agg(
        count_where(any_differs([c for c in RGBA if c not in selected])).alias("unselected_changes"),
        count_where(changed & domain & ~F.col("effect")).alias("changed_outside_effect"),
        count_where(guarded).alias("changed_guarded"),
    )


def seam_metrics(before: DataFrame, after: DataFrame, guard: DataFrame) -> DataFrame:
    """Changed texels per level and those inside the seam guard of that level."""
    keys = ["texture_id", "level", "x", "y"]
    b = before.select(*keys, *[F.col(c).alias(f"b_{c}") for c in "rgb"])
    a = after.select(*keys, *[F.col(c).alias(f"a_{c}") for c in "rgb"])
    changed = b.join(a, keys).withColumn("changed", any_differs(["r", "g", "b"]))
    marked = changed.join(guard.select(*keys, F.lit(True).alias("_g")), keys, "left")
    return marked.groupBy("texture_id", "level").agg(
        count_where(F.col("changed")).alias("changed_pixels"),
        count_where(F.col("changed") & F.col("_g")).alias("changed_inside_seam_guard"),
    )


def padding_mismatches(level: DataFrame, padded: DataFrame, covered: DataFrame) -> DataFrame:
    """Uncovered texels that differ from the padded picture."""
    pairs = paired(level, padded).join(covered.select(*KEY), KEY, "left_anti")
    return pairs.groupBy("texture_id").agg(count_where(any_differs(RGBA)).alias("padding_mismatch_pixels"))


# ---- derived maps ---------------------------------------------------------

#: Weights of one blur.
BINOMIAL = [1, 4, 6, 4, 1]


TILE = 64


def _halo_places(place: Column, size: Column, halo: int) -> Column:
    """Tiles of an axis that need a texel, and where it stands in them, counted from the start of the tile.

    The axis wraps around; a texel of a picture narrower than the halo stands several times in one tile.
    """
    turns = F.ceil(F.lit(halo) / size)
    copies = F.filter(F.transform(F.sequence(-turns, turns), lambda m: place + m * size), lambda p: (p >= -halo) & (p < size + halo))
    last = div(size - 1, TILE)

    def tiles(p: Column) -> Column:
        low = F.least(last, F.greatest(F.lit(0).cast("long"), F.floor((p - halo) / TILE)))
        high = F.least(last, F.floor((p + halo) / TILE))
        return F.transform(F.sequence(low, high), lambda t: F.struct(t.alias("tile"), (p - t * TILE).alias("at")))

    return F.flatten(F.transform(copies, tiles))


def _on_tiles(values: DataFrame, halo: int, work: Callable[[np.ndarray], dict[str, np.ndarray]], columns: list[str]) -> DataFrame:
    """``work`` on every 64 x 64 tile of ``v`` with a border of ``halo`` texels, over wrapped pictures.

    Only border texels are sent to more than one tile, so any number of filter passes that the halo covers costs one
    shuffle. A tile's group has (64 + 2 * halo)^2 rows at most.
    """
    kind = values.schema["texture_id"].dataType.simpleString()
    sized = with_sizes(values.select(*KEY, "v"), picture_sizes(values))
    across = sized.withColumn("_x", F.explode(_halo_places(F.col("x"), F.col("width"), halo)))
    spread = across.withColumn("_y", F.explode(_halo_places(F.col("y"), F.col("height"), halo)))
    rows = spread.select("texture_id", F.col("_x.tile").alias("tx"), F.col("_y.tile").alias("ty"), F.col("_x.at").alias("ax"), F.col("_y.at").alias("ay"), "v")

    def one(table: pa.Table) -> pa.Table:
        x, y = (table.column(c).to_numpy().astype(np.int64) + halo for c in ("ax", "ay"))
        grid = np.full((y.max() + 1, x.max() + 1), np.nan)
        grid[y, x] = table.column("v").to_numpy()
        made = work(grid)
        height, width = next(iter(made.values())).shape
        tx, ty = table.column("tx")[0].as_py(), table.column("ty")[0].as_py()
        ys, xs = np.divmod(np.arange(height * width), width)
        first = table.column("texture_id").slice(0, 1).take(pa.array(np.zeros(height * width, np.int64)))
        return pa.table([first, pa.array(xs + tx * TILE), pa.array(ys + ty * TILE), *[pa.array(made[c].reshape(-1)) for c in columns]], ["texture_id", "x", "y", *columns])

    schema = f"texture_id {kind}, x long, y long, " + ", ".join(f"{c} double" for c in columns)
    return rows.groupBy("texture_id", "tx", "ty").applyInArrow(one, schema)


def _convolved(grid: np.ndarray, axis: int, weights: list[int]) -> np.ndarray:
    """Weighted means of the texels along an axis that have all their neighbours."""
    n = grid.shape[axis] - len(weights) + 1
    parts = [np.take(grid, np.arange(k, k + n), axis) * (w / sum(weights)) for k, w in enumerate(weights)]
    out = parts[0]
    for part in parts[1:]:
        out = out + part
    return out


def binomial_blur(values: DataFrame, passes: int) -> DataFrame:
    """``passes`` wrapped 1-4-6-4-1 blurs of ``v`` along x and y."""
    if passes == 0:
        return values.select(*KEY, "v")

    def blur(grid: np.ndarray) -> dict[str, np.ndarray]:
        for _ in range(passes):
            grid = _convolved(_convolved(grid, 1, BINOMIAL), 0, BINOMIAL)
        return {"v": grid}

    return _on_tiles(values, 2 * passes, blur, ["v"])


def wrapped_gradient(values: DataFrame) -> DataFrame:
    """Central differences of ``v`` with wrap-around in x and y."""

    def differences(grid: np.ndarray) -> dict[str, np.ndarray]:
        inner = grid[1:-1, 1:-1]
        return {"v": inner, "gx": (grid[1:-1, 2:] - grid[1:-1, :-2]) * 0.5, "gy": (grid[2:, 1:-1] - grid[:-2, 1:-1]) * 0.5}

    return _on_tiles(values, 1, differences, ["v", "gx", "gy"])


def derive_normal(base: DataFrame, alpha: DataFrame, height: float, polarity: int, passes: int) -> DataFrame:
    """Packed normal from an alpha height field over a neutral base map."""
    if not 0.0 < height <= 8.0 or polarity not in (-1, 1) or not 0 <= passes <= 8:
        raise ValueError("height, polarity or bevel passes out of range")
    values = alpha.select(*KEY, (F.col("a") / 255.0).alias("v"))
    blurred = binomial_blur(values, passes).withColumn("v", F.col("v") * (height * polarity))
    slopes = wrapped_gradient(blurred).withColumns({"gx": F.round("gx", 12), "gy": F.round("gy", 12)})
    rows = base.join(slopes.select(*KEY, "gx", "gy"), KEY)
    effect = (F.abs("gx") > 1e-8) | (F.abs("gy") > 1e-8)
    # each step is its own projection, so no expression is repeated in the next
    length = F.sqrt(F.col("gx") ** 2 + F.col("gy") ** 2 + 1.0)
    rows = rows.withColumns({"effect": effect, "ln": length, **_named("n", decode_normal(F.col("g"), F.col("a")))})
    detail = {"x": -F.col("gx") / F.col("ln"), "y": F.col("gy") / F.col("ln"), "z": 1.0 / F.col("ln")}
    rows = rows.withColumns(_named("d", detail))
    rows = rows.withColumns(_named("m", blend_normals(_vector("n"), _vector("d"))))
    rows = rows.withColumns({"px": pack_axis(F.col("mx")), "py": pack_axis(F.col("my"))})
    rows = rows.withColumn("plen", packed_length(F.col("px"), F.col("py")))

    def corrected(c: str) -> Column:
        pulled = pack_axis(unpack_axis(F.col(c)) / F.col("plen") * 0.99)
        return F.when(F.col("plen") > 1.0, pulled).otherwise(F.col(c))

    return rows.select(
        *KEY, "r",
        F.when(F.col("effect"), corrected("py")).otherwise(F.col("g")).alias("g"), "b",
        F.when(F.col("effect"), corrected("px")).otherwise(F.col("a")).alias("a"),
        "effect", F.when(F.col("effect"), F.round("mz", 6)).alias("z"),
    )


def normal_gates(base: DataFrame, alpha: DataFrame, derived: DataFrame, minimum_z: float = MINIMUM_Z) -> DataFrame:
    """Size of a derived normal's effect and its two gates, one row per picture.

    ``below_minimum_z``: a blended normal leans below ``minimum_z``; ``no_op``: there is alpha, but no texel changed.
    A picture without effect has the least z 1.
    """
    pairs = paired(base, derived).join(derived.select(*KEY, "effect", "z"), KEY).join(alpha.select(*KEY, F.col("a").alias("_alpha")), KEY)
    changed = count_where(any_differs(RGBA))
    least = F.coalesce(F.min("z"), F.lit(1.0))
    return pairs.groupBy("texture_id").agg(
        count_where(F.col("effect")).alias("effect_pixels"), changed.alias("changed_pixels"), least.alias("min_combined_z"),
        (least < minimum_z).alias("below_minimum_z"), (F.bool_or(F.col("_alpha") > 0) & (changed == 0)).alias("no_op"),
    )


def _named(prefix: str, vector: dict[str, Column]) -> dict[str, Column]:
    return {f"{prefix}{k}": v for k, v in vector.items()}


def _vector(prefix: str) -> dict[str, Column]:
    return {k: F.col(f"{prefix}{k}") for k in "xyz"}


def derive_gloss(base: DataFrame, alpha: DataFrame, deltas: dict[str, float]) -> DataFrame:
    """Channel += delta * alpha with half-up rounding inside the alpha support."""
    if not any(deltas.values()) or any(c not in RGBA for c in deltas):
        raise ValueError("gloss deltas need an RGBA channel and a non-zero value")
    rows = base.join(alpha.select(*KEY, F.col("a").alias("m")), KEY)
    on = F.col("m") > 0

    def channel(c: str) -> Column:
        if c not in deltas:
            return F.col(c)
        moved = half_up(F.round(clip(F.col(c) + F.col("m") / 255.0 * deltas[c], 0.0, 255.0), 9))
        return F.when(on, moved).otherwise(F.col(c)).alias(c)

    return rows.select(*KEY, *[channel(c) for c in RGBA], on.alias("effect"))


def derived_metrics(base: DataFrame, derived: DataFrame, selected: list[str]) -> DataFrame:
    """Effect size, changes outside it and in unselected channels, no-op flag."""
    pairs = paired(base, derived).join(derived.select(*KEY, "effect"), KEY)
    changed = any_differs(RGBA)
    others = [c for c in RGBA if c not in selected]
    return pairs.groupBy("texture_id").agg(
        count_where(F.col("effect")).alias("effect_pixels"),
        count_where(changed).alias("changed_pixels_from_neutral_base"),
        count_where(changed & ~F.col("effect")).alias("changed_outside_effect_mask"),
        count_where(any_differs(others)).alias("changed_unselected_channels"),
        ((count_where(F.col("effect")) > 0) & (count_where(changed) == 0)).alias("no_op"),
    )


def output_gate(recorded: DataFrame, derived: DataFrame, expected: DataFrame, base: DataFrame, selected: list[str]) -> DataFrame:
    """Recorded metrics against a recount, and texel equality with a re-run."""
    recount = derived_metrics(base, derived, selected)
    same = paired(derived, expected, how="full").groupBy("texture_id").agg(
        count_where(F.col("b_r").isNull() | F.col("a_r").isNull() | any_differs(RGBA)).alias("texel_mismatches")
    )
    r = recorded.select("texture_id", F.col("effect_pixels").alias("r_effect"), F.col("changed").alias("r_changed"))
    ok = (
        (F.col("r_effect") == F.col("effect_pixels")) & (F.col("r_changed") == F.col("changed_pixels_from_neutral_base"))
        & (F.col("changed_outside_effect_mask") == 0) & (F.col("changed_unselected_channels") == 0) & (F.col("texel_mismatches") == 0)
    )
    return r.join(recount, "texture_id").join(same, "texture_id").select(
        "texture_id", "texel_mismatches", "effect_pixels", F.coalesce(ok, F.lit(False)).alias("passed")
    )
