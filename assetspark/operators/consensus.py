"""Reading consensus: overlap, greedy clustering and suppression, votes, regions.

Inputs are readings: image_id, seq, text, confidence, engine, model_signature,
rotation_deg, x0, y0, x1, y1. ``seq`` is the input order and breaks every tie.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions import boxes
from ..functions.arithmetic import count_where, div
from ..functions.text import agreement_text, is_blank, literal_text
from ..session import cut_lineage
from .skew import number_by_rows

CELL = 256


# ---- overlap pairs --------------------------------------------------------


def _in_cells(rows: DataFrame, cell: int) -> DataFrame:
    return rows.withColumn("_cx", F.explode(boxes.cell_range(F.col("x0"), F.col("x1"), cell))).withColumn(
        "_cy", F.explode(boxes.cell_range(F.col("y0"), F.col("y1"), cell))
    )


def overlap_pairs(rows: DataFrame, id_columns: list[str], extra: list[str] = [], cell: int = CELL) -> DataFrame:
    """Pairs of intersecting boxes of one image, each once and in both columns.

    ``id_columns[0]`` is the image, ``id_columns[1]`` the box id; left < right.
    Boxes meet in grid cells; a pair is kept only in the cell that holds the
    corner of its intersection, so no de-duplication shuffle is needed.
    """
    image, box_id = id_columns
    wide = _in_cells(rows.select(image, box_id, *boxes.SIDES, *extra), cell)
    keep = [box_id, *boxes.SIDES, *extra]
    left = wide.select(image, "_cx", "_cy", *[F.col(c).alias(f"l_{c}") for c in keep])
    right = wide.select(image, "_cx", "_cy", *[F.col(c).alias(f"r_{c}") for c in keep])
    corner_x, corner_y = F.greatest("l_x0", "r_x0"), F.greatest("l_y0", "r_y0")
    return (
        left.join(right, [image, "_cx", "_cy"])
        .filter(F.col(f"l_{box_id}") < F.col(f"r_{box_id}"))
        .filter((div(corner_x, cell) == F.col("_cx")) & (div(corner_y, cell) == F.col("_cy")))
        .filter((corner_x < F.least("l_x1", "r_x1")) & (corner_y < F.least("l_y1", "r_y1")))
        .drop("_cx", "_cy")
    )


def same_region_pairs(readings: DataFrame) -> DataFrame:
    """Pairs of readings that name the same place, with both overlap measures.

    Identical (box, text) readings are collapsed first, so repeated readings of
    one spot do not multiply; ``l_n`` and ``r_n`` count them.
    """
    shapes = (
        readings.withColumn("key", agreement_text(F.col("text")))
        .groupBy("image_id", *boxes.SIDES, "key")
        .agg(F.min("seq").alias("seq"), F.count("*").alias("n"))
    )
    pairs = overlap_pairs(shapes, ["image_id", "seq"], ["key", "n"])
    left, right = boxes.named("l_"), boxes.named("r_")
    return (
        pairs.withColumns({"iou": boxes.iou(left, right), "over_smaller": boxes.over_smaller(left, right)})
        .filter(boxes.same_text_region(left, right))
    )


# ---- independent components -----------------------------------------------

#: Columns that name a component of an image.
COMPONENT = ["_c0", "_c1", "_c2"]


def _sweep(rows: DataFrame, keys: list[str], low: str, high: str, out: str) -> DataFrame:
    """Number the stretches of an axis that no box bridges, in each group of ``keys``.

    The boxes are first reduced to one row per start, so the window of a group is bounded by the picture's side, not by
    its boxes.
    """
    starts = rows.groupBy(*keys, low).agg(F.max(high).alias("_reach"))
    along = Window.partitionBy(*keys).orderBy(low)
    reached = F.max("_reach").over(along.rowsBetween(Window.unboundedPreceding, -1))
    opened = starts.withColumn("_opens", F.when(reached > F.col(low), 0).otherwise(1))
    numbered = opened.select(*keys, low, F.sum("_opens").over(along).cast("int").alias(out))
    return rows.join(numbered, [*keys, low])


def overlap_components(rows: DataFrame) -> DataFrame:
    """Rows with the ``COMPONENT`` they belong to; boxes of different components of an image share no area.

    Three sweeps, along x, along y inside each stretch, and along x again. A component may hold boxes that do not
    overlap, but never parts two that do.
    """
    out = _sweep(rows, ["image_id"], "x0", "x1", COMPONENT[0])
    out = _sweep(out, ["image_id", COMPONENT[0]], "y0", "y1", COMPONENT[1])
    return _sweep(out, ["image_id", *COMPONENT[:2]], "x0", "x1", COMPONENT[2])


#: Pictures of so many boxes at most are walked as one component.
WHOLE = 4096


def _walked_apart(rows: DataFrame) -> DataFrame:
    """Rows with a ``COMPONENT``: sweeps cut the pictures with many boxes, any other picture is one component.

    The images with more than ``WHOLE`` boxes are few against the rows, so their ids are broadcast.
    """
    given = rows.filter("image_id is not null")
    large = F.broadcast(given.groupBy("image_id").agg(F.count("*").alias("_n")).filter(F.col("_n") > WHOLE).select("image_id"))
    small = given.join(large, "image_id", "left_anti").withColumns({c: F.lit(0) for c in COMPONENT})
    return small.unionByName(overlap_components(given.join(large, "image_id", "left_semi")))


class _Boxes:
    """Boxes of a component in growing arrays."""

    def __init__(self) -> None:
        self.n = 0
        self.sides = np.zeros((64, 4), np.int64)
        self.area = np.zeros(64, np.int64)
        self.confidence = np.zeros(64)
        self.texts: list[str] = []

    def add(self, box: tuple[int, int, int, int], text: str, confidence: float) -> None:
        if self.n == len(self.area):
            for name in ("sides", "area", "confidence"):
                held = getattr(self, name)
                setattr(self, name, np.concatenate([held, np.zeros_like(held)]))
        self.sides[self.n] = box
        self.area[self.n] = (box[2] - box[0]) * (box[3] - box[1])
        self.confidence[self.n] = confidence
        self.texts.append(text)
        self.n += 1

    def shared(self, box: tuple[int, int, int, int]) -> tuple[np.ndarray, np.ndarray]:
        """Places of the boxes that share area with ``box``, and the shared areas."""
        s = self.sides[: self.n]
        width = np.minimum(s[:, 2], box[2]) - np.maximum(s[:, 0], box[0])
        height = np.minimum(s[:, 3], box[3]) - np.maximum(s[:, 1], box[1])
        at = np.flatnonzero((width > 0) & (height > 0))
        return at, width[at] * height[at]


def _walk(
    rows: DataFrame, order: list[Column], fields: list[str], start: Callable[[], object], step: Callable[[object, tuple], object], out: str
) -> DataFrame:
    """Rows in their walk's result ``out``: every component is walked in ``order``, and ``step`` sees ``seq`` and ``fields`` of
    one row at a time and returns its result, or None for no row.

    Components lie sorted in their tasks and are read as a stream, so a task holds the state of one component only. The
    other columns pass through.
    """
    staged = _walked_apart(rows).withColumn("_order", F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]))
    keys = ["image_id", *COMPONENT]
    sorted_rows = staged.select(*rows.columns, *COMPONENT, "_order").repartition(*keys).sortWithinPartitions(*keys, "_order")
    kept = rows.columns

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (*keys, "seq", *fields)]
            taken, results = [], []
            for i, row in enumerate(zip(*columns, strict=True)):
                if row[: len(keys)] != now:
                    now, state = row[: len(keys)], start()
                result = step(state, row[len(keys) :])
                if result is not None:
                    taken.append(i)
                    results.append(result)
            picked = batch.select(kept)
            if len(taken) < batch.num_rows:
                picked = picked.take(pa.array(taken, pa.int64()))
            yield pa.RecordBatch.from_arrays([*picked.columns, pa.array(results, pa.int64())], [*kept, out])

    return sorted_rows.drop("_order").mapInArrow(walk, StructType([*rows.schema.fields, StructField(out, LongType())]))


# ---- greedy clustering ----------------------------------------------------


class _Clusters(_Boxes):
    """Readings with equal box and text form a class, which is matched with the others once.

    A reading joins the earliest cluster that holds a matching reading. ``joined`` is the earliest cluster with a reading of
    a class, ``reach`` the earliest one with a reading of a matching class.
    """

    def __init__(self) -> None:
        super().__init__()
        self.classes: dict[tuple, int] = {}
        self.near: list[list[int]] = []
        self.joined: list[int | None] = []
        self.reach: list[int | None] = []
        self.founders: list[int] = []

    def class_of(self, box: tuple[int, int, int, int], key: str) -> int:
        name = (*box, key)
        at = self.classes.get(name)
        if at is None:
            at = self.classes[name] = self.n
            area = (box[2] - box[0]) * (box[3] - box[1])
            near, shared = self.shared(box)
            same = shared / np.maximum(1, area + self.area[near] - shared) >= 0.55
            inside = shared / np.maximum(1, np.minimum(area, self.area[near])) >= 0.85
            self.add(box, key, 0.0)
            others = [
                j for j, s, i in zip(near.tolist(), same.tolist(), inside.tolist(), strict=True)
                if s or (i and key and self.texts[j] and (key in self.texts[j] or self.texts[j] in key))
            ]
            # a box without area matches nothing, not even itself
            self.near.append([*others, at] if box[0] < box[2] and box[1] < box[3] else others)
            for j in others:
                self.near[j].append(at)
            known = [self.joined[j] for j in others if self.joined[j] is not None]
            self.joined.append(None)
            self.reach.append(min(known, default=None))
        return at

    def place(self, row: tuple) -> int:
        seq, x0, y0, x1, y1, key = row
        at = self.class_of((x0, y0, x1, y1), key)
        home = self.reach[at]
        if home is None:
            home = len(self.founders)
            self.founders.append(seq)
        if self.joined[at] is None or home < self.joined[at]:
            self.joined[at] = home
            for j in self.near[at]:
                if self.reach[j] is None or home < self.reach[j]:
                    self.reach[j] = home
        return self.founders[home]


def _clustered(readings: DataFrame) -> DataFrame:
    """Readings with their ``key`` and cluster; the sides and ``seq`` become long."""
    longs = {c: F.col(c).cast("long") for c in ("seq", *boxes.SIDES)}
    rows = readings.withColumns({**longs, "key": agreement_text(F.col("text"))})
    order = [-F.col("confidence"), F.col("seq")]
    return _walk(rows, order, [*boxes.SIDES, "key"], _Clusters, _Clusters.place, "cluster_id")


def greedy_clusters(readings: DataFrame) -> DataFrame:
    """(image_id, seq, cluster_id): clusters by confidence order, named by founder.

    Readings that share no area never meet, so a large image is cut into components, which are walked apart.
    """
    rows = readings.select("image_id", "seq", "confidence", *boxes.SIDES, "text")
    return _clustered(rows).select("image_id", "seq", "cluster_id")


def cluster_readings(readings: DataFrame) -> DataFrame:
    """Readings with ``key`` and cluster, stored once because the votes read it often."""
    return cut_lineage(_clustered(readings))


# ---- votes ----------------------------------------------------------------


def _keyed(clustered: DataFrame) -> DataFrame:
    """With ``key``, the agreement text, which ``cluster_readings`` stores."""
    return clustered if "key" in clustered.columns else clustered.withColumn("key", agreement_text(F.col("text")))


def consensus(clustered: DataFrame) -> DataFrame:
    """One reading per cluster: text vote, rotation vote, best confidence.

    A vote goes to most models, most engines, highest confidence. Readings are reduced per text and rotation, then per text,
    then per cluster; clusters without any letters or digits take the best of all their readings.
    """
    keys = ["image_id", "cluster_id"]
    payload = ["text", "key", "confidence", "engine", "model_signature", "rotation_deg", *boxes.SIDES]

    def strongest(reading: str) -> Column:
        return F.max_by(reading, F.struct(F.col(f"{reading}.confidence"), -F.col(f"{reading}.seq")))

    def distinct(sets: str) -> Column:
        return F.size(F.array_distinct(F.flatten(F.collect_list(sets))))

    # models and engines come from the fixed list of configured recognizers
    turned = _keyed(clustered).select(*keys, "key", "rotation_deg", "engine", "model_signature", F.struct("seq", *payload).alias("r"))
    turned = turned.groupBy(*keys, "key", "rotation_deg").agg(
        F.collect_set("model_signature").alias("models"), F.collect_set("engine").alias("engines"), strongest("r").alias("r")
    )
    side = F.struct(F.size("models"), F.size("engines"), F.col("r.confidence"), -F.col("rotation_deg"))
    texts = turned.repartition(*keys).groupBy(*keys, "key").agg(
        distinct("models").alias("models"), distinct("engines").alias("engines"), strongest("r").alias("r"), F.max_by("r", side).alias("oriented")
    )
    rank = F.struct("models", "engines", F.col("r.confidence"), F.length("key"), -F.col("r.seq"))
    voted = F.max_by("oriented", F.when(F.col("key") != "", rank))
    return texts.groupBy(*keys).agg(F.coalesce(voted, strongest("r")).alias("b")).select(*keys, "b.*")


def alternatives(clustered: DataFrame, keep: int = 8) -> DataFrame:
    """Best reading per (model, text) of a cluster, the strongest ``keep``."""
    keys = ["image_id", "cluster_id"]
    rows = _keyed(clustered)
    best = F.max_by(
        F.struct("seq", "text", "confidence", "engine", "rotation_deg"),
        F.struct(F.col("confidence"), -F.col("seq")),
    )
    per_model = rows.groupBy(*keys, "model_signature", "key").agg(best.alias("b")).select(
        *keys, "model_signature", "key", "b.*"
    )
    window = Window.partitionBy(*keys).orderBy(F.desc("confidence"), "seq")
    return per_model.withColumn("position", F.row_number().over(window)).filter(F.col("position") <= keep)


def review_states(chosen: DataFrame, alts: DataFrame) -> DataFrame:
    """Agreement, conflict and review state of each chosen reading."""
    keys = ["image_id", "cluster_id"]
    best = chosen.select(*keys, F.col("key").alias("best_key"), F.col("confidence").alias("best_confidence"))
    floor = F.greatest(F.lit(0.45), F.col("best_confidence") * 0.65)
    loud = (F.col("key") != "") & (F.col("confidence") >= floor)
    per = alts.join(best, keys).groupBy(*keys).agg(
        (F.size(F.collect_set(F.when(F.col("key") == F.col("best_key"), F.col("engine")))) >= 2).alias("engine_agreement"),
        (F.size(F.collect_set(F.when(loud, F.col("key")))) > 1).alias("conflicting_readings"),
    )
    state = (
        F.when(F.col("conflicting_readings"), "conflict")
        .when(F.col("engine_agreement"), "agreement")
        .otherwise("single_engine")
    )
    return per.withColumn("review_state", state)


def number_regions(chosen: DataFrame, label: str) -> DataFrame:
    """``ocr-001`` style ids by (top, left) inside each image."""
    # the numbering reads its rows twice
    numbered = number_by_rows(cut_lineage(chosen), "image_id", "y0", ["x0", "seq"], "_no")
    return numbered.withColumn("region_label", F.format_string(f"{label}-%03d", F.col("_no").cast("int"))).drop("_no")


def selected_regions(regions: DataFrame, stages: DataFrame, stage: str, only_fallback: bool = True) -> DataFrame:
    """Regions of the targets whose newest record of ``stage`` passed; of those only the ones that ask for a fallback reading."""
    newest = stages.filter(F.col("stage") == stage).groupBy("target_id").agg(F.max_by("status", F.struct("ts", "status")).alias("status"))
    wanted = regions.filter(F.coalesce("needs_ocr_fallback", F.lit(False))) if only_fallback else regions
    return wanted.join(newest.filter("status = 'pass'"), "target_id", "left_semi")


# ---- greedy suppression ---------------------------------------------------


def visual_candidate() -> Column:
    wide = (F.col("x1") - F.col("x0") >= 4) & (F.col("y1") - F.col("y0") >= 4)
    sure = (F.col("confidence") >= 0.45) & ~((F.col("script") == "other") & (F.col("confidence") < 0.75))
    return wide & sure


def korean_candidate(script: str = "korean") -> Column:
    return (
        F.contains("script", F.lit(script)) & (F.col("confidence") >= 0.75) & ~is_blank(F.col("text"))
    )


def valid_reading(minimum: Column | float) -> Column:
    return (F.col("confidence") >= minimum) & ~is_blank(literal_text(F.col("text")))


class _Kept(_Boxes):
    """Boxes kept so far; a box goes if one of them covers it."""

    smaller = 0.0

    def covered(self, at: np.ndarray, text: str, confidence: float) -> bool:
        raise NotImplementedError

    def place(self, row: tuple) -> int | None:
        seq, x0, y0, x1, y1, text, confidence = row
        box = (x0, y0, x1, y1)
        area = (x1 - x0) * (y1 - y0)
        near, shared = self.shared(box)
        most = near[shared / np.maximum(1, np.minimum(area, self.area[near])) >= self.smaller]
        if len(most) and self.covered(most, text, confidence):
            return None
        self.add(box, text, confidence)
        return seq


class _Visual(_Kept):
    smaller = 0.78

    def covered(self, at: np.ndarray, text: str, confidence: float) -> bool:
        return bool((self.confidence[at] >= confidence * 0.7).any())


class _Reference(_Kept):
    smaller = 0.8

    def covered(self, at: np.ndarray, text: str, confidence: float) -> bool:
        return any(text in self.texts[j] for j in at.tolist())


def _suppress(rows: DataFrame, order: list[Column], kept: type[_Kept]) -> DataFrame:
    """Rows whose box no earlier kept box covers; components of an image are walked apart."""
    sides = [F.col(c).cast("long").alias(c) for c in boxes.SIDES]
    plain = rows.select("image_id", F.col("seq").cast("long").alias("seq"), *sides, "text", F.col("confidence").cast("double").alias("confidence"))
    left = _walk(plain, [*order, F.col("seq")], [*boxes.SIDES, "text", "confidence"], kept, kept.place, "_kept")
    return rows.join(left.select("image_id", "seq"), ["image_id", "seq"], "left_semi")


def visual_regions(readings: DataFrame) -> DataFrame:
    """Large boxes first; drop a box mostly inside a kept, confident one.

    Equal boxes collapse to their most confident reading beforehand: whatever
    decides about the first decides about the others.
    """
    rows = readings.filter(visual_candidate())
    first = F.max_by(F.struct(*[c for c in rows.columns if c not in ("image_id", *boxes.SIDES)]), F.struct(F.col("confidence"), -F.col("seq")))
    distinct = rows.groupBy("image_id", *boxes.SIDES).agg(first.alias("f")).select("image_id", *boxes.SIDES, "f.*")
    order = [-boxes.area({c: F.col(c) for c in boxes.SIDES}), -F.col("confidence")]
    return _suppress(distinct, order, _Visual)


def reference_regions(readings: DataFrame, script: str = "korean") -> DataFrame:
    """Reference-layout texts: drop a text repeated inside a kept box.

    Equal texts in equal boxes collapse beforehand; a box without area covers nothing, so each of those stays.
    """
    rows = readings.filter(korean_candidate(script))
    first = F.max_by(F.struct(*[c for c in rows.columns if c not in ("image_id", *boxes.SIDES, "text")]), F.struct(F.col("confidence"), -F.col("seq")))
    flat = (F.col("x0") >= F.col("x1")) | (F.col("y0") >= F.col("y1"))
    alone = F.when(flat, F.col("seq")).alias("_alone")
    distinct = rows.groupBy("image_id", *boxes.SIDES, "text", alone).agg(first.alias("f")).select(
        "image_id", *boxes.SIDES, "text", "f.*"
    )
    order = [-boxes.area({c: F.col(c) for c in boxes.SIDES}), -F.length("text"), -F.col("confidence")]
    return _suppress(distinct, order, _Reference)


# ---- region readings ------------------------------------------------------


def reading_order(tokens: DataFrame) -> DataFrame:
    """Line number and position of each token of a recognizer call.

    Tokens are walked by (cy, cx) and join the first line within 0.6 of the
    taller height. Calls are first cut into bands separated by more than 0.6 of
    the call's tallest token: no line crosses such a gap, so each band is folded
    on its own. Input: call_id, seq, cx, cy, height. Adds line, ordinal.
    """
    tallest = tokens.groupBy("call_id").agg(F.max("height").alias("_tall"))
    celled = tokens.join(tallest, "call_id").withColumn("_cell", F.floor(F.col("cy") / (F.col("_tall") * 0.6)))
    cells = celled.select("call_id", "_cell").distinct()
    up = Window.partitionBy("call_id").orderBy("_cell")
    gap = F.col("_cell") - F.lag("_cell").over(up) > 1
    banded = cells.withColumn("_gap", F.coalesce(gap, F.lit(False)).cast("int")).withColumn(
        "_band", F.sum("_gap").over(up.rowsBetween(Window.unboundedPreceding, 0))
    )
    rows = celled.join(banded.select("call_id", "_cell", "_band"), ["call_id", "_cell"])
    item = F.struct(F.col("cy").alias("cy"), F.col("cx").alias("cx"), F.col("seq").alias("seq"), F.col("height").alias("h"))
    bands = rows.groupBy("call_id", "_band").agg(F.array_sort(F.collect_list(item)).alias("items"))
    line_type = "struct<center:double,height:double,members:array<struct<cx:double,cy:double,seq:bigint>>>"

    def place(lines: Column, it: Column) -> Column:
        near = lambda ln: F.abs(it["cy"] - ln["center"]) <= F.greatest(it["h"], ln["height"]) * 0.6
        slot = F.array_position(F.transform(lines, near), F.lit(True)).cast("int")
        member = F.struct(it["cx"].alias("cx"), it["cy"].alias("cy"), it["seq"].alias("seq"))
        fresh = F.struct(it["cy"].alias("center"), it["h"].alias("height"), F.array(member).alias("members"))

        def grow(ln: Column, i: Column) -> Column:
            n = F.size(ln["members"])
            joined = F.struct(
                ((ln["center"] * n + it["cy"]) / (n + 1)).alias("center"),
                F.greatest(ln["height"], it["h"]).alias("height"),
                F.array_append(ln["members"], member).alias("members"),
            )
            return F.when(i == slot - 1, joined).otherwise(ln)

        return F.when(slot > 0, F.transform(lines, grow)).otherwise(F.array_append(lines, fresh))

    folded = bands.select("call_id", "_band", F.aggregate("items", F.array().cast(f"array<{line_type}>"), place).alias("lines"))
    lines = folded.select("call_id", "_band", F.size("lines").alias("_lines"), F.posexplode("lines").alias("_i", "ln"))
    in_band = Window.partitionBy("call_id", "_band").orderBy("ln.center", "_i")
    placed = lines.withColumn("_line", F.row_number().over(in_band) - 1)
    counts = placed.groupBy("call_id", "_band").agg(
        F.count("*").alias("_nl"), F.sum(F.size("ln.members")).alias("_nt")
    )
    above = Window.partitionBy("call_id").orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "call_id", "_band",
        F.coalesce(F.sum("_nl").over(above), F.lit(0)).alias("_line0"),
        F.coalesce(F.sum("_nt").over(above), F.lit(0)).alias("_token0"),
    )
    members = placed.join(offsets, ["call_id", "_band"]).select(
        "call_id", "_band", (F.col("_line0") + F.col("_line")).alias("line"), "_token0", F.posexplode("ln.members").alias("_j", "m")
    )
    walk = Window.partitionBy("call_id", "_band").orderBy("line", "m.cx", "_j")
    return members.select(
        "call_id", F.col("m.seq").alias("seq"), "line", (F.col("_token0") + F.row_number().over(walk) - 1).alias("ordinal")
    )


def spans_equal_to(tokens: DataFrame, expected: DataFrame) -> DataFrame:
    """Contiguous token spans whose composed text equals an expected text.

    ``tokens``: call_id, region_id, ordinal, line, text (trimmed literal),
    confidence. ``expected``: region_id, expected_text. Tokens are joined by a
    space inside a line and a newline across lines. Instead of composing every
    span, the end of a span is found by its text offset: a start token has at
    most one end token for a given length; only those spans are compared.
    """
    before = Window.partitionBy("call_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    placed = tokens.withColumn("from_char", F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)))
    placed = placed.withColumn("to_char", F.col("from_char") + F.length("text"))
    starts = placed.join(expected, "region_id").select(
        "call_id", "region_id", "expected_text", F.col("ordinal").alias("first"), F.col("from_char").alias("base"),
        (F.col("from_char") + F.length("expected_text")).alias("to_char"),
    )
    spans = starts.join(placed.select("call_id", "to_char", F.col("ordinal").alias("last")), ["call_id", "to_char"]).filter(
        F.col("last") >= F.col("first")
    )
    inside = spans.withColumn("ordinal", F.explode(F.sequence("first", "last"))).join(
        placed.select("call_id", "ordinal", "line", "text", "confidence", "from_char", F.lag("line").over(
            Window.partitionBy("call_id").orderBy("ordinal")
        ).alias("line_before")),
        ["call_id", "ordinal"],
    )
    at = F.col("from_char") - F.col("base")
    piece_ok = F.substring("expected_text", at + 1, F.length("text")) == F.col("text")
    separator = F.when(F.col("line") == F.col("line_before"), F.lit(" ")).otherwise(F.lit("\n"))
    joint_ok = (at == 0) | (F.substring("expected_text", at, F.lit(1)) == separator)
    return (
        inside.groupBy("call_id", "region_id", "expected_text", "first", "last")
        .agg(F.bool_and(piece_ok & joint_ok).alias("equal"), F.min("confidence").alias("confidence"))
        .filter("equal")
        .drop("equal")
    )


def composite_spans(tokens: DataFrame) -> DataFrame:
    """Every contiguous span of two or more tokens of a call, composed into one text.

    ``tokens``: call_id, ordinal, line, text, confidence and any columns that a span takes from its first token. Tokens are
    trimmed and joined by a space inside a line and a newline across lines; blank tokens are left out before. Returns the
    span's ``first`` and ``last`` ordinal, text, least confidence (six digits) and ``components``, the tokens' own texts. A call of n
    tokens has n * (n - 1) / 2 spans; each start holds the rest of its call once and its spans are cut from that.
    """
    carried = [c for c in tokens.columns if c not in ("call_id", "ordinal", "line", "text", "confidence")]
    valid = tokens.withColumn("_t", F.btrim(literal_text(F.col("text")))).filter(~is_blank(F.col("_t")))
    onward = Window.partitionBy("call_id").orderBy("ordinal").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    token = F.struct("ordinal", "line", "_t", F.col("text").alias("own"), "confidence")
    starts = valid.select("call_id", *carried, F.collect_list(token).over(onward).alias("rest")).filter(F.size("rest") > 1)

    def piece(item: Column, i: Column) -> Column:
        before = F.get("rest", i - 1)
        return F.when(i == 0, item["_t"]).when(before["line"] == item["line"], F.concat(F.lit(" "), item["_t"])).otherwise(F.concat(F.lit("\n"), item["_t"]))

    cut = starts.withColumn("pieces", F.transform("rest", piece)).withColumn("n", F.explode(F.sequence(F.lit(2), F.size("rest"))))
    span = F.slice("rest", F.lit(1), F.col("n"))
    return cut.select(
        "call_id", *carried, F.get("rest", F.lit(0))["ordinal"].alias("first"), F.get("rest", F.col("n") - 1)["ordinal"].alias("last"),
        F.array_join(F.slice("pieces", F.lit(1), F.col("n")), "").alias("text"),
        F.round(F.array_min(F.transform(span, lambda item: item["confidence"])), 6).alias("confidence"),
        F.transform(span, lambda item: item["own"]).alias("components"),
    )


def region_readings(tokens: DataFrame) -> DataFrame:
    """Best reading per (region, model, variant, literal text) among single tokens and composed spans.

    Ties go to the single token, then to the earlier start and the shorter span; calls are taken in the order of their ids.
    ``tokens`` as in ``composite_spans`` with region_id, model_signature, variant and engine. ``components`` is null for a single token.
    """
    keep = ["call_id", "region_id", "engine", "model_signature", "variant"]
    spans = composite_spans(tokens.select(*keep, "ordinal", "line", "text", "confidence"))
    single = tokens.filter(~is_blank(F.btrim(literal_text(F.col("text"))))).select(
        *keep, F.col("ordinal").alias("first"), F.col("ordinal").alias("last"), "text", "confidence", F.lit(None).cast("array<string>").alias("components")
    )
    rows = single.unionByName(spans).withColumn("text", literal_text(F.col("text")))
    key = ["region_id", "model_signature", "variant", "text"]
    fields = ["call_id", "engine", "first", "last", "confidence", "components"]
    rank = F.struct(
        -F.col("confidence"), F.col("call_id"), F.col("components").isNotNull().alias("span"), F.col("first"), F.col("last")
    )
    # few spans share a key, so they are not sorted before they are sent: a task that composes them holds no table of them
    sent = rows.select(*key, *fields).repartition(*key)
    return sent.groupBy(*key).agg(F.min_by(F.struct(*fields), rank).alias("b")).select(*key, "b.*")


def call_composites(tokens: DataFrame) -> DataFrame:
    """All tokens of one recognizer call joined by spaces, in input order.

    The composed text is the result, so a call is as long as its output row.
    """
    valid = tokens.withColumn("key", agreement_text(F.col("text"))).filter("key <> ''")
    parts = F.array_sort(F.collect_list(F.struct("seq", F.btrim("text").alias("t"))))
    return (
        valid.groupBy("call_id")
        .agg(parts.alias("p"), F.round(F.min("confidence"), 6).alias("confidence"))
        .filter(F.size("p") > 1)
        .select("call_id", F.array_join(F.transform("p", lambda e: e["t"]), " ").alias("text"), "confidence", F.size("p").alias("components"))
    )


def reading_store(readings: DataFrame, keys: list[str]) -> DataFrame:
    """Most confident reading per key; the earlier one wins a tie."""
    rest = [c for c in readings.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(F.col("confidence"), -F.col("seq")))
    return readings.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


def region_matches(readings: DataFrame, expected: DataFrame) -> DataFrame:
    """Match flag and matching engines of each approved region."""
    joined = expected.join(readings.select("region_id", "text", "engine"), "region_id", "left")
    hit = literal_text(F.col("text")) == F.col("expected_text")
    # engines are the fixed list of recognizers
    return joined.groupBy("region_id", "expected_text").agg(
        F.coalesce(F.bool_or(hit), F.lit(False)).alias("matched"),
        F.array_join(F.array_sort(F.collect_set(F.when(hit, F.col("engine")))), "|").alias("matching_engines"),
    )


def top_readings(readings: DataFrame, group: str, keep: int = 16) -> DataFrame:
    window = Window.partitionBy(group).orderBy(F.desc("confidence"), "seq")
    return readings.withColumn("position", F.row_number().over(window)).filter(F.col("position") <= keep)


def occurrence_counts(regions: DataFrame, capable: DataFrame) -> DataFrame:
    """Expected and required occurrences per text.

    ``regions``: text, occurrences, ocr_required (null = unspecified);
    ``capable``: text, capable.
    """
    given = F.col("ocr_required").isNotNull()
    n = F.col("occurrences")
    sums = regions.groupBy("text").agg(
        F.sum(n).alias("expected"),
        F.sum(F.when(given, n).otherwise(0)).alias("explicit"),
        F.sum(F.when(F.col("ocr_required"), n).otherwise(0)).alias("explicit_required"),
    )
    open_count = F.when(F.coalesce("capable", F.lit(False)), F.col("expected") - F.col("explicit")).otherwise(0)
    return sums.join(capable, "text", "left").select(
        "text", "expected", (F.col("explicit_required") + open_count).alias("required")
    )


def compare_counts(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Full-outer comparison of two count tables keyed by text."""
    joined = expected.join(actual, "text", "full")
    want, have = F.coalesce("expected", F.lit(0)), F.coalesce("actual", F.lit(0))
    return joined.select(
        "text", want.alias("expected"), have.alias("actual"),
        F.col("expected").eqNullSafe(F.col("actual")).alias("equal"),
        (F.col("expected").isNotNull() & (have > want)).alias("duplicate"),
    )


def region_completeness(plan: DataFrame, results: DataFrame) -> DataFrame:
    """Per target: every planned region has a result, and every one matches."""
    r = results.select("region_id", "matched", "match_mode", F.col("expected_text").alias("result_text"), F.lit(True).alias("found"))
    joined = plan.join(r, "region_id", "left")
    good = F.col("matched") & (F.col("match_mode") == "nfc-literal") & F.col("result_text").eqNullSafe(F.col("text"))
    return joined.groupBy("target_id").agg(
        F.bool_and(F.col("found").isNotNull()).alias("complete"),
        F.bool_and(F.coalesce(good, F.lit(False))).alias("all_matched"),
        count_where(F.coalesce(good, F.lit(False))).alias("matched_regions"),
    )


def target_reports(rows: DataFrame) -> DataFrame:
    """Batch report per target from (target_id, status, conflict, reused)."""
    return rows.groupBy("target_id").agg(
        F.count("*").alias("detections"),
        count_where(F.col("conflict")).alias("conflicting_regions"),
        count_where(F.col("reused")).alias("reused"),
        count_where(F.col("status") == "error").alias("errors"),
        F.bool_and(F.col("status") != "error").alias("passed"),
    )


def reusable_reports(wanted: DataFrame, reports: DataFrame, identity: list[str]) -> tuple[DataFrame, DataFrame]:
    """Targets whose stored report can be reused, and those left to do."""
    usable = reports.filter("status = 'completed' and errors = 0").select("target_id", *identity).distinct()
    named = wanted.filter("regions > 0").select("target_id", *identity)
    reuse = named.join(usable, ["target_id", *identity], "left_semi").select("target_id")
    return reuse, wanted.join(reuse, "target_id", "left_anti").select("target_id")


# ---- preprocessing plans --------------------------------------------------


def variant_plan(
    images: DataFrame, tile: int, overlap: int, rotations: list[int], contrasts: list[str], max_variants: int = 0
) -> DataFrame:
    """Variant rows of each image: backgrounds x (overview + tiles) x contrast x rotation.

    ``images``: image_id, width, height, has_alpha. When a cap is set, images
    above it give a single row with the ``too_many_variants`` error.
    """
    width, height = F.col("width"), F.col("height")
    grid = images.withColumns(
        {"xs": boxes.tile_origins(width, tile, overlap), "ys": boxes.tile_origins(height, tile, overlap)}
    )
    backgrounds = F.when(F.col("has_alpha"), F.array(F.lit("white"), F.lit("black"))).otherwise(F.array(F.lit("opaque")))
    overview = F.greatest(width, height) > tile
    total = F.size(backgrounds) * (F.size("xs") * F.size("ys") + overview.cast("int")) * len(contrasts) * len(rotations)
    grid = grid.withColumns({"background": backgrounds, "overview": overview, "total": total})
    over = (F.lit(max_variants) > 0) & (F.col("total") > max_variants)
    tiles = F.flatten(
        F.transform("ys", lambda y: F.transform("xs", lambda x: F.struct(
            x.alias("x"), y.alias("y"),
            (F.least(width, x + tile) - x).alias("w"), (F.least(height, y + tile) - y).alias("h"),
        )))
    )
    name = F.format_string("tile_x%d_y%d_w%d_h%d", "p.x", "p.y", "p.w", "p.h")
    whole = F.struct(F.lit(-1).cast("long").alias("x"), F.lit(-1).cast("long").alias("y"), width.cast("long").alias("w"), height.cast("long").alias("h"))
    parts = F.when(F.col("overview"), F.concat(F.array(whole), tiles)).otherwise(tiles)
    rows = (
        grid.filter(~over)
        .withColumn("background", F.explode("background"))
        .withColumn("p", F.explode(parts))
        .withColumn("contrast", F.explode(F.array(*[F.lit(c) for c in contrasts])))
        .withColumn("rotation", F.explode(F.array(*[F.lit(r) for r in rotations])))
    )
    region = F.when(F.col("p.x") < 0, F.lit("overview")).otherwise(name)
    variant = F.concat_ws(":", "background", region, "contrast", F.concat(F.lit("r"), "rotation"))
    good = rows.select("image_id", variant.alias("variant_id"), "total", F.lit(None).cast("string").alias("error"))
    bad = grid.filter(over).select(
        "image_id", F.lit(None).cast("string").alias("variant_id"), "total", F.lit("too_many_variants").alias("error")
    )
    return good.unionByName(bad)
