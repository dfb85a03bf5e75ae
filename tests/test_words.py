"""Masks as words, runs of shapes and shares of boxes against plain texel sets."""

import random

import pytest
from pyspark.sql import functions as F

from assetspark.operators import mesh, texels, words

MASK = "texture_id long, x long, y long"
W, H = 203, 150
KEYS = ["texture_id"]


def drawn(seed, share, pictures=2):
    rng = random.Random(seed)
    return {(t, x, y) for t in range(pictures) for x in range(W) for y in range(H) if rng.random() < share}


def mask(spark, points):
    return spark.createDataFrame(sorted(points), MASK)


def points(df):
    rows = [(r.texture_id, r.x, r.y) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_words_give_back_their_texels(spark):
    some = drawn(1, 0.1) | {(0, 63, 0), (0, 64, 0), (0, 127, 5)}
    table = words.texel_words(mask(spark, some), KEYS)
    assert points(words.word_texels(table, KEYS)) == some
    assert words.word_texels(table.limit(0), KEYS).count() == 0


def test_algebra(spark):
    a, b = drawn(2, 0.2), drawn(3, 0.2, 3)
    left, right = (words.texel_words(mask(spark, m), KEYS) for m in (a, b))
    assert points(words.word_texels(words.union_words(left, right, KEYS), KEYS)) == a | b
    assert points(words.word_texels(words.intersect_words(left, right, KEYS), KEYS)) == a & b
    assert points(words.word_texels(words.subtract_words(left, right, KEYS), KEYS)) == a - b


@pytest.mark.parametrize("radius", [0, 1, 5, 33, 70])
def test_dilation(spark, radius):
    some = drawn(4, 0.0003) | {(0, 0, 0), (0, W - 1, H - 1), (1, 64, 70)}
    want = {
        (t, px, py) for t, x, y in some for px in range(max(0, x - radius), min(W, x + radius + 1)) for py in range(max(0, y - radius), min(H, y + radius + 1))
    }
    assert points(texels.dilate(mask(spark, some), radius, W, H)) == want


def test_polygons(spark):
    rng = random.Random(5)
    shapes = {p: [(rng.randrange(W), rng.randrange(H)) for _ in range(rng.randrange(3, 8))] for p in range(12)}
    edges = [(0, p, *a, *b) for p, corners in shapes.items() for a, b in zip(corners, corners[1:] + corners[:1])]
    table = spark.createDataFrame(edges, "texture_id long, polygon int, x0 long, y0 long, x1 long, y1 long")
    got = {(r.polygon, r.x, r.y) for r in texels.polygon_texels(mask(spark, {(0, x, y) for x in range(W) for y in range(H)}), table).collect()}
    want = set()
    for _, p, x0, y0, x1, y1 in edges:
        for y in range(min(y0, y1), max(y0, y1)):
            at = x0 + (y + 0.5 - y0) * (x1 - x0) / (y1 - y0)
            want ^= {(p, x, y) for x in range(W) if at <= x + 0.5}
    assert got == want


def test_recipe_keeps_inside_its_rectangle(spark):
    rng = random.Random(6)
    rows = [(0, x, y, rng.randrange(2)) for x in range(90) for y in range(40)]
    picture = spark.createDataFrame(rows, "texture_id long, x long, y long, r int")
    boxes = {0: (-3, 2, 70, 20), 1: (60, 15, 88, 60), 2: (5, 5, 5, 9)}
    regions = spark.createDataFrame([(0, i, *b) for i, b in boxes.items()], "texture_id long, region_id int, x0 int, y0 int, x1 int, y1 int")
    seam = {(0, x, 17) for x in range(90)}
    got = {(r.region_id, r.x, r.y) for r in texels.recipe_selection(picture, regions, F.col("r") == 1, 2, mask(spark, seam), (90, 40)).collect()}
    want = set()
    for i, (x0, y0, x1, y1) in boxes.items():
        inside = {(x, y) for _, x, y, r in rows if r == 1 and x0 <= x < x1 and y0 <= y < y1}
        grown = {(px, py) for x, y in inside for px in range(x - 2, x + 3) for py in range(y - 2, y + 3)}
        want |= {(i, x, y) for x, y in grown if x0 <= x < x1 and y0 <= y < y1 and 0 <= x < 90 and 0 <= y < 40 and (0, x, y) not in seam}
    assert got == want


def test_shares_of_boxes(spark):
    rng = random.Random(7)
    a, b = drawn(8, 0.3), drawn(9, 0.05)
    every = sorted(a | b)
    flags = spark.createDataFrame([(*p, p in a, p in b) for p in every], "texture_id long, x long, y long, a boolean, b boolean")
    boxes = [(rng.randrange(3), i, *sorted((rng.randrange(-9, W + 9), rng.randrange(-9, W + 9))), *sorted((rng.randrange(-9, H + 9), rng.randrange(-9, H + 9)))) for i in range(60)]
    boxes += [(0, 60, 0, 64, 0, 64), (0, 61, 64, 128, 64, 128), (1, 62, 0, 203, 0, 150), (1, 63, 10, 10, 3, 9), (0, 64, 63, 65, 63, 129), (0, 65, 0, 192, 3, 61)]
    table = spark.createDataFrame([(t, i, x0, y0, x1, y1) for t, i, x0, x1, y0, y1 in boxes], "texture_id long, box_id long, x0 long, y0 long, x1 long, y1 long")
    got = {r.box_id: (round(r.a, 12), round(r.b, 12)) for r in words.box_mask_shares(table, flags, ["a", "b"], W, H).collect()}
    for t, i, x0, x1, y0, y1 in boxes:
        x0, x1, y0, y1 = (min(max(v, 0), limit) for v, limit in ((x0, W), (x1, W), (y0, H), (y1, H)))
        area = (x1 - x0) * (y1 - y0)
        want = tuple(round(sum((t, x, y) in m for x in range(x0, x1) for y in range(y0, y1)) / area, 12) if area > 0 else 0.0 for m in (a, b))
        assert got[i] == want, i
    assert len(got) == len(boxes)


def test_triangle_rows_equal_the_whole_box(spark):
    rng = random.Random(10)
    rows = [(0, i, *[round(rng.uniform(-0.4, 1.4), 3) for _ in range(6)]) for i in range(40)]
    rows += [(0, 40, 0.5, 0.5, 0.5, 0.5, 0.5, 0.5), (0, 41, 0.1, 0.5, 0.9, 0.5, 0.4, 0.5), (0, 42, 0.2, 0.1, 0.2, 0.9, 0.2, 0.5), (0, 43, 0.1, 0.1, 0.9, 0.101, 0.5, 0.1)]
    got = {}
    for r in rows:
        got[r[1]] = r
    df = spark.createDataFrame(rows, "mesh int, tri int, ua double, va double, ub double, vb double, uc double, vc double")
    size = 40
    want = set()
    for _, i, ua, va, ub, vb, uc, vc in rows:
        for su in range(-3, 4):
            for sv in range(-3, 4):
                p = [(round((u + su) * (size - 1), 6), round((1 - v - sv) * (size - 1), 6)) for u, v in ((ua, va), (ub, vb), (uc, vc))]
                if not (min(u + su for u in (ua, ub, uc)) <= 1 and max(u + su for u in (ua, ub, uc)) >= 0 and min(v + sv for v in (va, vb, vc)) <= 1 and max(v + sv for v in (va, vb, vc)) >= 0):
                    continue
                for x in range(size):
                    for y in range(size):
                        if not (min(q[0] for q in p) <= x <= max(q[0] for q in p) and min(q[1] for q in p) <= y <= max(q[1] for q in p)):
                            continue
                        s = [round((b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]), 6) for a, b in ((p[0], p[1]), (p[1], p[2]), (p[2], p[0]))]
                        if not (min(s) < 0 < max(s)):
                            want.add((i, x, y))
    each = {(r.mesh, r.x, r.y) for r in mesh.triangle_coverage(df.withColumn("mesh", F.col("tri")), size, size).collect()}
    assert each == want
