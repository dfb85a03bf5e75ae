"""Mesh edges, vertex merging and UV coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .texels import dilate


def triangle_edges(triangles: DataFrame, keys: list[str]) -> DataFrame:
    """Undirected edges (lo, hi) of triangles with vertices a, b, c."""
    ends = F.array(*[F.struct(F.col(p).alias("p"), F.col(q).alias("q")) for p, q in (("a", "b"), ("b", "c"), ("c", "a"))])
    return triangles.select(*keys, F.explode(ends).alias("e")).select(
        *keys, F.least("e.p", "e.q").alias("lo"), F.greatest("e.p", "e.q").alias("hi")
    )


def boundary_edges(triangles: DataFrame, keys: list[str]) -> DataFrame:
    """Edges used by exactly one triangle of their (sub)mesh."""
    return (
        triangle_edges(triangles, keys)
        .groupBy(*keys, "lo", "hi")
        .agg(F.count("*").alias("uses"))
        .filter("uses = 1")
        .drop("uses")
    )


def merge_vertices(vertices: DataFrame, tolerance: float = 1e-5) -> DataFrame:
    """Representative vertex of equal (position, uv) after quantization.

    Half-even rounding of value/tolerance; the representative is the smallest
    id. An aggregation plus join is used, so a hot position combines map-side.
    """
    signature = F.struct(*[F.bround(F.col(c) / tolerance).cast("long").alias(c) for c in ("px", "py", "pz", "u", "v")])
    keyed = vertices.select("mesh", "vid", signature.alias("sig"))
    merged = keyed.groupBy("mesh", "sig").agg(F.min("vid").alias("rep"))
    return keyed.join(merged, ["mesh", "sig"]).select("mesh", "vid", "rep")


def merged_boundary(triangles: DataFrame, vertices: DataFrame, tolerance: float = 1e-5) -> DataFrame:
    """Boundary edges after merging equal vertices; ends keep their own ids."""
    reps = merge_vertices(vertices, tolerance)
    keys = ["mesh", "submesh"]
    ends = F.array(*[F.struct(F.col(p).alias("p"), F.col(q).alias("q")) for p, q in (("a", "b"), ("b", "c"), ("c", "a"))])
    edges = triangles.select(*keys, F.explode(ends).alias("e")).select(*keys, "e.p", "e.q")
    joined = edges.join(reps.select("mesh", F.col("vid").alias("p"), F.col("rep").alias("rp")), ["mesh", "p"]).join(
        reps.select("mesh", F.col("vid").alias("q"), F.col("rep").alias("rq")), ["mesh", "q"]
    )
    return (
        joined.groupBy(*keys, F.least("rp", "rq").alias("lo"), F.greatest("rp", "rq").alias("hi"))
        .agg(F.count("*").alias("uses"), F.min("p").alias("p"), F.min("q").alias("q"))
        .filter("uses = 1")
        .select(*keys, "p", "q")
    )


def mesh_stats(triangles: DataFrame, vertices: DataFrame) -> DataFrame:
    """UV bounds and counts per mesh; meshes without triangles are dropped."""
    v = vertices.groupBy("mesh").agg(
        F.count("*").alias("vertices"), F.min("u").alias("u_min"), F.max("u").alias("u_max"),
        F.min("v").alias("v_min"), F.max("v").alias("v_max"),
    )
    per_sub = triangles.groupBy("mesh", "submesh").agg(F.count("*").alias("n"))
    t = per_sub.groupBy("mesh").agg(F.count("*").alias("submeshes"), F.sum("n").alias("triangles"))
    return v.join(t, "mesh")


def _shifts(low: Column, high: Column) -> Column:
    """Integer shifts that bring [low, high] onto the unit interval."""
    first, last = F.ceil(-high).cast("long"), F.floor(1 - low).cast("long")
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))


def _repeated(shapes: DataFrame, points: list[str], width: int, height: int) -> DataFrame:
    """Every repeat of a UV shape that touches the picture, in pixel units."""
    us, vs = [f"u{p}" for p in points], [f"v{p}" for p in points]
    moved = shapes.withColumn("su", F.explode(_shifts(F.least(*us), F.greatest(*us)))).withColumn(
        "sv", F.explode(_shifts(F.least(*vs), F.greatest(*vs)))
    )
    columns = {}
    for p in points:
        columns[f"x{p}"] = F.round((F.col(f"u{p}") + F.col("su")) * (width - 1), 6)
        columns[f"y{p}"] = F.round((1 - F.col(f"v{p}") - F.col("sv")) * (height - 1), 6)
    return moved.withColumns(columns)


def triangle_coverage(triangles: DataFrame, width: int, height: int) -> DataFrame:
    """(mesh, x, y) of texels whose centre lies in some repeat of a triangle.

    A texel is covered if the three half-plane products do not disagree in
    sign. Every pixel row is scanned between the triangle's edges, one texel wider on both sides to
    leave the decision to the products.
    """
    placed = _repeated(triangles, ["a", "b", "c"], width, height)
    xs, ys = ["xa", "xb", "xc"], ["ya", "yb", "yc"]
    x0, x1 = F.greatest(F.ceil(F.least(*xs)), F.lit(0)), F.least(F.floor(F.greatest(*xs)), F.lit(width - 1))
    y0, y1 = F.greatest(F.ceil(F.least(*ys)), F.lit(0)), F.least(F.floor(F.greatest(*ys)), F.lit(height - 1))
    cells = (
        placed.withColumns({"x0": x0, "x1": x1, "y0": y0, "y1": y1})
        .filter("x0 <= x1 and y0 <= y1")
        .withColumn("y", F.explode(F.sequence("y0", "y1")))
    )

    def crossings(p: str, q: str) -> list[Column]:
        """Where an edge meets the pixel row: one place, both ends of a level edge, or null."""
        xp, yp, xq, yq = (F.col(f"{axis}{v}") for v in (p, q) for axis in "xy")
        met = (F.least(yp, yq) <= F.col("y")) & (F.col("y") <= F.greatest(yp, yq))
        level = yp == yq
        place = xp + (F.col("y") - yp) * (xq - xp) / F.when(~level, yq - yp)
        return [F.when(met, F.when(level, xp).otherwise(place)), F.when(met, F.when(level, xq).otherwise(place))]

    places = [c for p, q in (("a", "b"), ("b", "c"), ("c", "a")) for c in crossings(p, q)]
    # on rows that the corners only touch within rounding no edge is met: the whole width of the box is scanned then
    low, high = F.coalesce(F.floor(F.least(*places)) - 1, F.col("x0")), F.coalesce(F.ceil(F.greatest(*places)) + 1, F.col("x1"))
    runs = cells.withColumns({"_low": F.greatest(low, F.col("x0")), "_high": F.least(high, F.col("x1"))}).filter("_low <= _high")
    cells = runs.withColumn("x", F.explode(F.sequence("_low", "_high")))

    def side(p: str, q: str) -> Column:
        value = (F.col(f"x{q}") - F.col(f"x{p}")) * (F.col("y") - F.col(f"y{p}")) - (
            F.col(f"y{q}") - F.col(f"y{p}")
        ) * (F.col("x") - F.col(f"x{p}"))
        return F.round(value, 6)

    sides = [side("a", "b"), side("b", "c"), side("c", "a")]
    inside = ~((F.least(*sides) < 0) & (F.greatest(*sides) > 0))
    return cells.filter(inside).select("mesh", "x", "y").distinct()


def edge_texels(edges: DataFrame, width: int, height: int) -> DataFrame:
    """Texels along repeated UV edges (ua, va)-(ub, vb), one step per pixel."""
    placed = _repeated(edges, ["a", "b"], width, height)
    reach = F.greatest(F.abs(F.col("xb") - F.col("xa")), F.abs(F.col("yb") - F.col("ya")))
    steps = F.greatest(F.ceil(reach), F.lit(1))
    walked = placed.withColumn("steps", steps).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("steps"))))
    share = F.col("i") / F.col("steps")

    def at(axis: str) -> Column:
        start, end = F.col(f"{axis}a"), F.col(f"{axis}b")
        return F.floor(F.round(start + (end - start) * share, 6) + 0.5)

    return (
        walked.select("mesh", at("x").alias("x"), at("y").alias("y"))
        .filter(f"x >= 0 and x < {width} and y >= 0 and y < {height}")
        .distinct()
    )


def seam_guard(edges: DataFrame, padding: int, width: int, height: int) -> DataFrame:
    """Edge texels grown by the padding."""
    raw = edge_texels(edges, width, height).withColumnRenamed("mesh", "texture_id")
    return dilate(raw, padding, width, height).withColumnRenamed("texture_id", "mesh")


def uv_review(triangles: DataFrame, edges: DataFrame, padding: int, width: int, height: int) -> DataFrame:
    """Guard, coverage and edge counts per mesh; empty results fail the review."""
    guard = seam_guard(edges, padding, width, height).groupBy("mesh").agg(F.count("*").alias("guard_pixels"))
    cover = triangle_coverage(triangles, width, height).groupBy("mesh").agg(F.count("*").alias("coverage_pixels"))
    count = edges.groupBy("mesh").agg(F.count("*").alias("boundary_edge_count"))
    joined = count.join(guard, "mesh", "left").join(cover, "mesh", "left").fillna(0)
    return joined.withColumn("passed", (F.col("guard_pixels") > 0) & (F.col("coverage_pixels") > 0))
