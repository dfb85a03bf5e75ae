"""Measurements of an edit effect after compression.

Input rows (texture_id, level, x, y) carry the intended and the decoded value of
each selected channel for three pictures: ``is/in/ie`` (intended source, neutral,
edited) and ``as/an/ae`` (decoded), plus the flags old_text, new_text, covered,
protected and seam_guard of that level. Everything is grouped per texture, level
and stage; windows only span 4x4 blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arithmetic import count_where, div
from ..functions.color import decode_normal, unpack_axis

GROUP = ["texture_id", "level"]
STAGE = [*GROUP, "stage"]

# Limits of the compression gate.
SUPPORT_BYTE_THRESHOLD = 2
REMOVAL_MINIMUM = 8
HIGH_RESIDUAL_RATIO = 0.8
LEAK_TOTAL_LIMITS = {"old-effect-removal": 0.06, "new-effect": 0.1}


def block_any(flag: Column, block: int = 4) -> Column:
    """Whether any texel of the 4x4 block has the flag."""
    cell = Window.partitionBy(*GROUP, div(F.col("x"), block), div(F.col("y"), block))
    return F.max(flag).over(cell)


def _stage_rows(levels: DataFrame, channels: list[str]) -> DataFrame:
    """One row per texel and stage, with intended and actual deltas as arrays."""

    def deltas(after: str, before: str) -> Column:
        return F.array(*[F.col(f"{after}_{c}") - F.col(f"{before}_{c}") for c in channels])

    marked = levels.withColumns(
        {"old_block": block_any(F.col("old_text")), "new_block": block_any(F.col("new_text"))}
    )
    stages = F.array(
        F.struct(
            F.lit("old-effect-removal").alias("stage"), (F.col("old_text") & F.col("covered")).alias("domain"),
            F.col("old_block").alias("block"), deltas("in", "is").alias("want"), deltas("an", "as").alias("got"),
        ),
        F.struct(
            F.lit("new-effect").alias("stage"), (F.col("new_text") & F.col("covered")).alias("domain"),
            F.col("new_block").alias("block"), deltas("ie", "in").alias("want"), deltas("ae", "an").alias("got"),
        ),
    )
    return marked.select(*GROUP, "x", "y", "covered", F.explode(stages).alias("s")).select(
        *GROUP, "x", "y", "covered", "s.*"
    )


def _any_above(values: str, limit: Column) -> Column:
    return F.exists(values, lambda v: F.abs(v) > limit)


def _energy(values: str) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda t, v: t + F.abs(v))


def staged(levels: DataFrame, channels: list[str]) -> DataFrame:
    """Stage rows with support flags; the geometry threshold is per stage."""
    rows = _stage_rows(levels, channels)
    zero = F.lit(0)
    rows = rows.withColumns(
        {
            "want_any": F.col("domain") & _any_above("want", zero),
            "got_any": F.col("covered") & F.col("block") & _any_above("got", zero),
        }
    )
    peak = rows.groupBy(*STAGE).agg(
        F.max(F.when(F.col("want_any"), F.array_max(F.transform("want", F.abs)))).alias("peak")
    )
    limit = F.when(F.col("peak") <= SUPPORT_BYTE_THRESHOLD, 0).otherwise(SUPPORT_BYTE_THRESHOLD)
    return rows.join(peak, STAGE).withColumn("limit", limit).withColumns(
        {
            "want_shape": F.col("domain") & _any_above("want", F.col("limit")),
            "got_shape": F.col("covered") & F.col("block") & _any_above("got", F.col("limit")),
        }
    )


def support_metrics(rows: DataFrame) -> DataFrame:
    """Recall, precision, IoU and leaked energy of the effect support."""
    want, got = F.col("want_shape"), F.col("got_shape")
    leak = got & ~want
    sums = rows.groupBy(*STAGE).agg(
        count_where(F.col("want_any")).alias("intended_texels"),
        count_where(F.col("want_any") & F.col("got_any")).alias("kept"),
        count_where(want & got).alias("both"),
        count_where(want).alias("wanted"),
        count_where(got).alias("found"),
        F.coalesce(F.sum(F.when(want, _energy("want"))), F.lit(0)).alias("shape_energy"),
        F.coalesce(F.sum(F.when(leak, _energy("got"))), F.lit(0)).alias("leaked_energy"),
        F.coalesce(F.max(F.when(leak, F.array_max(F.transform("got", F.abs)))), F.lit(0)).alias("leaked_delta_max"),
    )
    union = F.col("wanted") + F.col("found") - F.col("both")

    def ratio(a: Column, b: Column) -> Column:
        return F.round(F.when(b > 0, a / b).otherwise(1.0), 6)

    return sums.select(
        *STAGE, "intended_texels",
        ratio(F.col("kept"), F.col("intended_texels")).alias("support_recall"),
        ratio(F.col("both"), F.col("found")).alias("support_precision"),
        ratio(F.col("both"), union).alias("support_iou"),
        F.round(F.col("leaked_energy") / F.greatest(F.col("shape_energy"), F.lit(1)), 6).alias("leaked_energy_ratio"),
        "leaked_delta_max", "leaked_energy", "shape_energy",
    )


def support_alignment(rows: DataFrame) -> DataFrame:
    """Centre and box errors between intended and decoded effect shapes."""

    def geometry(flag: str, delta: str, p: str) -> list[Column]:
        on = F.col(flag)
        weight = F.when(on, _energy(delta))
        return [
            (F.sum((F.col("x") + 0.5) * weight) / F.sum(weight)).alias(f"{p}cx"),
            (F.sum((F.col("y") + 0.5) * weight) / F.sum(weight)).alias(f"{p}cy"),
            F.min(F.when(on, F.col("x"))).alias(f"{p}x0"), F.min(F.when(on, F.col("y"))).alias(f"{p}y0"),
            (F.max(F.when(on, F.col("x"))) + 1).alias(f"{p}x1"), (F.max(F.when(on, F.col("y"))) + 1).alias(f"{p}y1"),
        ]

    per = rows.groupBy(*STAGE).agg(*geometry("want_shape", "want", "w"), *geometry("got_shape", "got", "g"))
    centre = F.greatest(F.abs(F.col("wcx") - F.col("gcx")), F.abs(F.col("wcy") - F.col("gcy")))
    edge = F.greatest(*[F.abs(F.col(f"w{s}") - F.col(f"g{s}")) for s in ("x0", "y0", "x1", "y1")])
    return per.filter("wcx is not null and gcx is not null").select(
        *STAGE, F.round(centre, 6).alias("center_error_texels"), edge.alias("bbox_edge_error_texels")
    )


def energy_metrics(rows: DataFrame) -> DataFrame:
    """Energy ratio, direction recall and delta errors over the intended support."""
    parts = rows.filter("want_any").select(
        *STAGE, F.explode(F.arrays_zip("want", "got")).alias("p")
    ).select(*STAGE, F.col("p.want").alias("w"), F.col("p.got").alias("g"))
    same = F.col("w") * F.col("g") > 0
    directed = F.col("w") != 0
    error = F.abs(F.col("g") - F.col("w"))
    # deltas are bytes: at most 511 distinct errors per group
    sums = parts.groupBy(*STAGE).agg(
        F.sum(F.abs("w")).alias("want_energy"),
        F.sum(F.abs("g")).alias("got_energy"),
        F.avg(F.when(directed, same.cast("double"))).alias("recall"),
        F.coalesce(F.sum(F.when(directed & ~same, F.abs("g"))), F.lit(0)).alias("wrong"),
        F.percentile(error, F.array(F.lit(0.95), F.lit(0.99))).alias("p"),
        F.max(error).alias("delta_error_max"),
    )
    floor = F.greatest(F.col("want_energy"), F.lit(1))
    return sums.select(
        *STAGE,
        F.round(F.col("got_energy") / floor, 6).alias("energy_ratio"),
        F.round("recall", 6).alias("direction_recall"),
        F.round(F.col("wrong") / floor, 6).alias("wrong_direction_energy_ratio"),
        F.round(F.col("p")[0], 6).alias("delta_error_p95"), F.round(F.col("p")[1], 6).alias("delta_error_p99"),
        "delta_error_max",
    )


def energy_bounds(level: Column) -> tuple[Column, Column]:
    """Allowed energy ratio by level."""
    low = F.when(level == 0, 0.75).when(level == 1, 0.65).when(level == 2, 0.5).otherwise(0.2)
    high = F.when(level == 0, 1.25).when(level == 1, 1.5).when(level == 2, 2.0).otherwise(6.0)
    return low, high


def residual_metrics(levels: DataFrame, channels: list[str]) -> DataFrame:
    """What is left of a removed effect, over clearly removed components."""
    parts = F.array(*[
        F.struct((F.col(f"in_{c}") - F.col(f"is_{c}")).alias("removal"), F.abs(F.col(f"ae_{c}") - F.col(f"ie_{c}")).alias("residual"))
        for c in channels
    ])
    rows = levels.filter("old_text and covered").select(*GROUP, F.explode(parts).alias("p")).select(
        *GROUP, F.abs("p.removal").alias("removal"), F.col("p.residual").alias("residual")
    ).filter(F.col("removal") >= REMOVAL_MINIMUM)
    per = rows.groupBy(*GROUP).agg(
        F.count("*").alias("components"),
        F.round(F.sum("residual") / F.sum("removal"), 6).alias("residual_energy_ratio"),
        F.round(F.avg((F.col("residual") / F.col("removal") >= HIGH_RESIDUAL_RATIO).cast("double")), 6).alias("high_residual_fraction"),
    )
    level = F.col("level")
    energy_limit = F.when(level == 0, 0.25).otherwise(0.4)
    share_limit = F.when(level == 0, 0.1).when(level <= 5, 0.25).otherwise(0.5)
    ok = (F.col("residual_energy_ratio") <= energy_limit) & (F.col("high_residual_fraction") <= share_limit)
    return per.withColumn("within_limits", ok)


def protected_metrics(levels: DataFrame, channels: list[str]) -> DataFrame:
    """Error and normal-angle statistics in the protected and seam area."""
    area = levels.filter("(protected or seam_guard) and covered")
    errors = F.array(*[F.abs(F.col(f"as_{c}") - F.col(f"ae_{c}")) for c in channels])
    error_rows = area.select(*GROUP, F.explode(errors).alias("e"))
    # byte errors: at most 256 distinct values per group
    per = error_rows.groupBy(*GROUP).agg(
        F.percentile("e", F.array(F.lit(0.95), F.lit(0.99))).alias("p"), F.max("e").alias("protected_max")
    )

    def vector(prefix: str) -> tuple[dict[str, Column], Column]:
        g, a = F.col(f"{prefix}_g"), F.col(f"{prefix}_a")
        n = decode_normal(g, a, inside_disk=False)
        length = F.sqrt(unpack_axis(a) ** 2 + unpack_axis(g) ** 2)
        return n, length

    (s, s_len), (e, e_len) = vector("as"), vector("ae")
    dot = s["x"] * e["x"] + s["y"] * e["y"] + s["z"] * e["z"]
    angle = F.round(F.degrees(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot)))), 3)
    invalid = ((s_len <= 1.0) & (e_len > 1.0)) | ((s["z"] >= 0.05) & (e["z"] < 0.05))
    # angles are kept to a thousandth of a degree, which bounds the percentile state
    angles = area.groupBy(*GROUP).agg(
        F.percentile(angle, F.array(F.lit(0.95), F.lit(0.99))).alias("q"), F.max(angle).alias("angle_max"),
        count_where(invalid).alias("newly_invalid"),
    )
    return per.join(angles, GROUP).select(
        *GROUP,
        F.round(F.col("p")[0], 6).alias("protected_p95"), F.round(F.col("p")[1], 6).alias("protected_p99"), "protected_max",
        F.round(F.col("q")[0], 3).alias("angle_p95"), F.round(F.col("q")[1], 3).alias("angle_p99"), "angle_max", "newly_invalid",
    )


def cumulative_leaks(support: DataFrame) -> DataFrame:
    """Leak ratio over all levels, with the limit of each stage."""
    per = support.groupBy("texture_id", "stage").agg(
        F.sum("leaked_energy").alias("leaked"), F.sum("shape_energy").alias("energy")
    )
    limit = F.when(F.col("stage") == "new-effect", LEAK_TOTAL_LIMITS["new-effect"]).otherwise(
        LEAK_TOTAL_LIMITS["old-effect-removal"]
    )
    ratio = F.col("leaked") / F.greatest(F.col("energy"), F.lit(1))
    return per.select(
        "texture_id", "stage", F.round(ratio, 6).alias("cumulative_leaked_energy_ratio"),
        ((F.col("energy") == 0) | (ratio <= limit)).alias("within_limit"),
    )


def outside_changes(levels: DataFrame, channels: list[str]) -> DataFrame:
    """Decoded changes outside the blocks an effect touches, and in guarded texels."""
    changed = F.lit(False)
    for c in channels:
        changed = changed | (F.col(f"as_{c}") != F.col(f"ae_{c}"))
    allowed = block_any(F.col("old_text") | F.col("new_text"))
    rows = levels.withColumns({"changed": changed, "allowed": allowed})
    guarded = F.col("protected") | F.col("seam_guard")
    return rows.groupBy(*GROUP).agg(
        count_where(F.col("changed") & F.col("covered") & ~F.col("allowed")).alias("changed_outside_effect_blocks"),
        count_where(F.col("changed") & guarded).alias("changed_inside_protected_or_seam"),
        count_where(F.col("covered") & ~F.col("allowed")).alias("checked_unaffected_texels"),
    )
