import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assetspark.operators import graph, mesh, mips, ranges, texels

TEXEL = "texture_id long, x long, y long, r long, g long, b long, a long"


def picture(spark, array, texture=1):
    h, w = array.shape[:2]
    rows = [(texture, x, y, *map(int, array[y, x])) for y in range(h) for x in range(w)]
    return spark.createDataFrame(rows, TEXEL)


def test_alpha_projection_is_half_up(spark):
    array = np.zeros((4, 4, 4), int)
    array[0, 0, 3] = 2  # block sum 2 of 4 -> 0.5 -> 1
    array[2, 2, 3] = 1
    got = {(r.x, r.y): r.a for r in texels.project_alpha(picture(spark, array), 2).collect()}
    assert got == {(0, 0): 1, (1, 0): 0, (0, 1): 0, (1, 1): 0}


def test_mip_chain_of_flat_color_is_flat(spark):
    array = np.full((8, 8, 4), [10, 128, 200, 255])
    for role in ("diffuse", "gloss"):
        rows = mips.mip_chain(picture(spark, array), role, 4).filter("level = 3").collect()
        assert [(r.r, r.g, r.b, r.a) for r in rows] == [(10, 128, 200, 255)]


def test_nearest_fill_equals_brute_force(spark):
    rng = random.Random(5)
    covered = {(x, y) for x in range(70) for y in range(9) if rng.random() < 0.02} | {(69, 8)}
    array = np.random.default_rng(1).integers(0, 255, (9, 70, 4))
    df = picture(spark, array).withColumn("covered", F.concat_ws(",", "x", "y").isin([f"{x},{y}" for x, y in covered]))
    for r in texels.pad_outside(df).collect():
        best = min((((cx - r.x) ** 2 + (cy - r.y) ** 2), cy, cx) for cx, cy in covered)
        assert (r.source_y, r.source_x) == best[1:]


def test_boundary_edges_and_seams(spark):
    tri = spark.createDataFrame([(0, 0, 0, 0, 1, 2), (0, 0, 1, 3, 2, 4)], "mesh int, submesh int, tri int, a int, b int, c int")
    same = [(0, 0, 0.0, 0.0, 0.0, 0.0, 0.0), (0, 1, 1.0, 0.0, 0.0, 1.0, 0.0), (0, 2, 0.0, 1.0, 0.0, 0.0, 1.0), (0, 3, 1.0, 0.0, 0.0, 1.0, 0.0), (0, 4, 1.0, 1.0, 0.0, 1.0, 1.0)]
    schema = "mesh int, vid int, px double, py double, pz double, u double, v double"
    merged = mesh.merged_boundary(tri, spark.createDataFrame(same, schema))
    assert merged.count() == 4  # the shared edge 1-2 / 3-2 is inside
    split = [r if r[1] != 3 else (*r[:5], 0.5, 0.0) for r in same]
    assert mesh.merged_boundary(tri, spark.createDataFrame(split, schema)).count() == 6


def test_ranges_merge_when_they_touch(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 5, 9), (1, 20, 22), (1, 21, 40), (1, 3, 4)], "grp int, start long, end long")
    for bucket in (4, 1 << 20):
        got = {(r.start, r.end) for r in ranges.merge_ranges(df, bucket).collect()}
        assert got == {(0, 9), (20, 40)}


def test_two_hop_discovery(spark):
    slots = spark.createDataFrame(
        [("c", 1, "_MainTex", "a", 101), ("c", 1, "_BumpMap", "b", 202), ("d", 2, "_BumpMap", "b", 202), ("e", 3, "_BumpMap", "b", 999)],
        "bundle_key string, material_path_id long, property string, texture_bundle_key string, path_id long",
    )
    targets = spark.createDataFrame([("a", 101, "t")], "texture_bundle_key string, path_id long, target_id string")
    deps = spark.createDataFrame([("c", "a"), ("c", "b"), ("d", "b"), ("e", "b")], "bundle_key string, depends_on string")
    known = slots.select(*graph.MATERIAL).limit(0)
    got = {(r.bundle_key, r.hop) for r in graph.external_materials(slots, targets, deps, known).collect()}
    assert got == {("c", 1), ("d", 2)}
    assert [(r.texture_bundle_key, r.path_id) for r in graph.auxiliary_pointers(slots, targets).collect()] == [("b", 202)]


def test_payload_size(spark):
    row = spark.range(1).select(texels.payload_size(F.lit(4096).cast("long"), F.lit(4096).cast("long")).alias("n")).first()
    assert row.n == 22_369_648


def area_matrix(n):
    """Plain area weights of one axis: target rows, source columns, in double precision."""
    m = max(1, n // 2)
    scale = n / m
    out = np.zeros((m, n))
    for j in range(m):
        for i in range(n):
            out[j, i] = max(0.0, min(i + 1, (j + 1) * scale) - max(i, j * scale)) / scale
    return out


def shrink(values):
    return np.einsum("ji,ik...,lk->jl...", area_matrix(values.shape[0]), values, area_matrix(values.shape[1]))


@pytest.mark.parametrize("shape", [(5, 7), (1, 9), (9, 1), (6, 4), (3, 1), (1, 1)])
def test_odd_mips_weight_by_area(spark, shape):
    array = np.random.default_rng(3).integers(0, 256, (*shape, 4))
    rows = mips.mip_chain(picture(spark, array), "gloss", 4).collect()
    want = array.astype(float)
    for level in range(4):
        got = {(r.y, r.x): (r.r, r.g, r.b, r.a) for r in rows if r.level == level}
        assert got == {(y, x): tuple(want[y, x].astype(int)) for y in range(want.shape[0]) for x in range(want.shape[1])}
        want = np.round(np.round(shrink(want), 9))


def test_odd_masks_keep_visible_shares(spark):
    # 4097 texels become 2048: the last texel of a target's border shares less than 1/510 of it
    mask = spark.createDataFrame([(1, 1, 0), (1, 4096, 0), (1, 2, 0)], "texture_id long, x long, y long")
    sizes = spark.createDataFrame([(1, 4097, 1)], "texture_id long, width long, height long")
    got = {r.x for r in mips.mask_chain(mask, 2, sizes).filter("level = 1").collect()}
    assert got == {0, 1, 2047}
    only = mask.filter("x = 2")  # 2048 units each, target 0 ends at 4097: one unit of texel 2 lies in it
    assert {r.x for r in mips.mask_chain(only, 2, sizes).filter("level = 1").collect()} == {1}


def test_chain_with_coverage_spreads_covered_colors(spark):
    array = np.zeros((2, 4, 4), int)
    array[..., 2:] = 255
    array[:, 0, :3] = (255, 0, 0)
    covered = spark.createDataFrame([(1, 0, 0), (1, 0, 1)], "texture_id long, x long, y long")
    rows = mips.mip_chain(picture(spark, array), "diffuse", 3, coverage=covered).collect()
    assert {(r.x, r.y, r.b) for r in rows if r.level == 0} == {(x, y, 0 if x == 0 else 255) for x in range(4) for y in range(2)}
    assert {(r.level, r.r, r.g, r.b) for r in rows if r.level > 0} == {(1, 255, 0, 0), (2, 255, 0, 0)}
    with pytest.raises(ValueError):
        mips.mip_chain(picture(spark, array), "unknown", 2)
    with pytest.raises(ValueError):
        mips.mip_chain(picture(spark, array), "gloss", 0)


@pytest.mark.parametrize("shape, passes", [((70, 150), 3), ((5, 64), 1), ((1, 3), 8), ((129, 65), 8)])
def test_blur_and_gradient_on_tiles_equal_whole_pictures(spark, shape, passes):
    values = np.random.default_rng(6).random(shape)
    rows = [(t, x, y, float(values[y, x]) + t) for t in (1, 2) for y in range(shape[0]) for x in range(shape[1])]
    df = spark.createDataFrame(rows, "texture_id long, x long, y long, v double")
    want = values
    for _ in range(passes):
        for axis in (1, 0):
            want = sum(np.roll(want, 2 - k, axis) * (w / 16) for k, w in enumerate([1, 4, 6, 4, 1]))
    got = mips.wrapped_gradient(mips.binomial_blur(df, passes)).collect()
    assert len(got) == len(rows)
    gx = (np.roll(want, -1, 1) - np.roll(want, 1, 1)) * 0.5
    gy = (np.roll(want, -1, 0) - np.roll(want, 1, 0)) * 0.5
    for r in got:
        assert abs(r.v - r.texture_id - want[r.y, r.x]) < 1e-12
        assert abs(r.gx - gx[r.y, r.x]) < 1e-12 and abs(r.gy - gy[r.y, r.x]) < 1e-12


def test_differences_are_walked_along_the_ranges_once(spark):
    before = spark.createDataFrame([(1, p, p) for p in range(12)] + [(2, 3, 0)], "grp int, pos long, value long")
    after = spark.createDataFrame([(1, p, -p) for p in range(1, 14)] + [(2, 3, 0)], "grp int, pos long, value long")
    merged = spark.createDataFrame([(1, 2, 5), (1, 9, 11), (3, 0, 9)], "grp int, start long, end long")
    out = ranges.differences_outside(before, after, merged)
    got = {r.pos: (r.b_value, r.a_value) for r in out.collect()}
    assert got == {0: (0, None), **{p: (p, -p) for p in (1, 5, 6, 7, 8, 11)}, 12: (None, -12), 13: (None, -13)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") <= 2  # the walk and its carried ends
