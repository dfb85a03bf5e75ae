"""Mixing sources to target weights with a low-discrepancy schedule of slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import word_count

#: Slots that a source has at least (if it has as many words), and the largest block in words.
MIN_SLOTS = 256
MAX_BLOCK = 2048
#: The golden ratio's fraction in units of 2^-53.
GOLDEN = 5566755282872655
BITS = 53
#: Slots of one generated part of the sequence, and units of the cumulative weights in one cell.
PART = 65536
CELL = 256


def source_order() -> list[Column]:
    """Sources by code point, null last."""
    return [F.col("source").isNull(), F.encode("source", "utf-8")]


def source_targets(sizes: DataFrame, weights: list[int], share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """Target words per source: (source, nr, source_size, target).

    The whole mix has ``share`` times all words, split by weight; a source stops at ``limit``
    times its own words and the rest is shared again by weight. Sharing again and again ends at
    one level L with target = min(limit * size, weight * L). The input has one row per source,
    summed before the rows meet in one window.
    """
    n = len(weights)
    picked = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("nr") - 1) % n + 1).cast("int"))
    before = Window.orderBy("_full", "nr").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    return (
        sizes.withColumn("nr", F.row_number().over(Window.orderBy(*source_order())))
        .withColumn("weight", picked)
        .withColumn("_cap", limit * F.col("source_size"))
        .withColumn("_full", F.col("_cap") / F.col("weight"))
        .withColumn("_words", F.sum("source_size").over(everything) * share - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        .withColumn("_weights", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        # the first source, by cap per weight, that stays under its cap sets the level
        .withColumn("_level", F.col("_words") / F.col("_weights"))
        .withColumn("_open", F.col("_full") > F.col("_level"))
        .withColumn("_level", F.min_by(F.when(F.col("_open"), F.col("_level")), F.when(F.col("_open"), F.col("_full"))).over(everything))
        .select("source", "nr", "source_size", F.coalesce(F.least("_cap", F.col("weight") * F.col("_level")), "_cap").alias("target"))
    )


def block_layout(targets: DataFrame) -> DataFrame:
    """Blocks and slots per source, and its place in the cumulative slots.

    A turn is one pass over a source's blocks; its last block may be short. The slots of a
    source cover its target rounded to a whole word.
    """
    size, words, block = F.col("source_size"), F.col("take_words"), F.col("block_words")
    up_to = Window.orderBy("nr").rowsBetween(Window.unboundedPreceding, 0)
    return (
        targets.withColumn("take_words", F.round("target").cast("long"))
        .withColumn("block_words", F.greatest(F.lit(1), F.least(F.lit(MAX_BLOCK), F.floor(F.col("target") / MIN_SLOTS))).cast("long"))
        .withColumn("blocks", F.ceil(size / block).cast("long"))
        .withColumn("_turns", F.when(size > 0, F.floor(words / size)).otherwise(0).cast("long"))
        .withColumn("slots", F.col("_turns") * F.col("blocks") + F.ceil((words - F.col("_turns") * size) / block).cast("long"))
        .withColumn("_to", F.sum("slots").over(up_to))
        .withColumn("_from", F.col("_to") - F.col("slots"))
        .drop("_turns")
    )


def golden_point(n: Column) -> Column:
    """n times the golden ratio modulo 1, in units of 2^-53, for any n below 2^43 without leaving 64 bits.

    Both factors are split, and parts of a product that only fill whole turns are cut off.
    """
    high, low = GOLDEN >> 26, GOLDEN & ((1 << 26) - 1)
    n1, n0 = F.floor(n / (1 << 20)), n.bitwiseAND((1 << 20) - 1)
    total = (
        n0 * F.lit(low)
        + (n0 * F.lit(high)).bitwiseAND((1 << (BITS - 26)) - 1) * F.lit(1 << 26)
        + (n1 * F.lit(low)).bitwiseAND((1 << (BITS - 20)) - 1) * F.lit(1 << 20)
        + (n1 * F.lit(high)).bitwiseAND((1 << (BITS - 46)) - 1) * F.lit(1 << 46)
    )
    return total.bitwiseAND((1 << BITS) - 1)


def schedule(layout: DataFrame) -> DataFrame:
    """The slots of the mix: (slot, nr, rank), to be read in the order of ``slot``.

    Slot n stands at the fractional part of n times the golden ratio and goes to the source
    whose stretch of the cumulative weights holds that point, so any run of slots has the
    sources close to their shares. ``rank`` numbers the slots of a source from 0. A few more
    slots are drawn than asked and the rest is left out; ranks that a source still misses follow
    as slots after the last one, so each source gets exactly its number.

    The sequence is made in parts, dealt over the tasks; points meet stretches in cells of the
    cumulative weights, and ranks are counted inside a part after the parts before it.
    """
    total = layout.agg(F.sum("slots").alias("_total"), F.count("*").alias("_sources")).filter("_total > 0")
    drawn = total.withColumn("_drawn", F.col("_total") + F.floor(F.col("_total") / 16) + 64 * F.col("_sources"))
    last = F.least((F.col("_part") + 1) * PART, "_drawn") - 1
    points = (
        drawn.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_drawn") - 1) / PART))))
        .repartition("_part")
        .withColumn("slot", F.explode(F.sequence(F.col("_part") * PART, last)))
        .withColumn("_unit", golden_point(F.col("slot") + 1))
        .withColumn("_at", F.floor(F.col("_unit") / F.lit(float(1 << BITS)) * F.col("_total")))
        .select("slot", "_part", "_at", F.floor(F.col("_at") / CELL).alias("_cell"))
    )
    cells = layout.filter("slots > 0").select(
        "nr", "slots", "_from", "_to",
        F.explode(F.sequence(F.floor(F.col("_from") / CELL), F.floor((F.col("_to") - 1) / CELL))).alias("_cell"),
    )
    drawn_slots = points.join(cells, "_cell").filter("_at >= _from and _at < _to").select("slot", "_part", "nr", "slots")
    earlier = Window.partitionBy("nr").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = drawn_slots.groupBy("nr", "_part").agg(F.count("*").alias("_n"))
    skips = counts.select("nr", "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_skip"))
    got = layout.select("nr", "slots").join(counts.groupBy("nr").agg(F.sum("_n").alias("_got")), "nr", "left")
    before = Window.orderBy("nr").rowsBetween(Window.unboundedPreceding, -1)  # one row per source
    missing = (
        got.withColumn("_got", F.coalesce("_got", F.lit(0))).filter("slots > _got")
        .withColumn("_skip", F.coalesce(F.sum(F.col("slots") - F.col("_got")).over(before), F.lit(0)))
        .crossJoin(drawn.select("_drawn"))
        .withColumn("rank", F.explode(F.sequence(F.col("_got"), F.col("slots") - 1)))
        .select((F.col("_drawn") + F.col("_skip") + F.col("rank") - F.col("_got")).alias("slot"), "nr", "rank")
    )
    inside = Window.partitionBy("nr", "_part").orderBy("slot")
    return (
        drawn_slots.withColumn("_nr", F.row_number().over(inside))
        .join(skips, ["nr", "_part"])
        .withColumn("rank", F.col("_skip") + F.col("_nr") - 1)
        .filter("rank < slots")
        .select("slot", "nr", "rank")
        .unionByName(missing)
    )


def mix_plan(
    docs: DataFrame, weights: list[int], share: float = 1.5, limit: float = 2.0,
    size: Column | None = None, id_col: str = "doc_id",
) -> DataFrame:
    """One row per document: id, source, size, source_size, target, taken, full_takes, first_slot and slots.

    Every source's documents are shuffled by a hash of their id and cut into blocks of equal
    words. Each slot of the schedule takes the next block of its source; after the last block
    the source starts again. The last slot of a source is cut to its target. ``taken`` counts a
    document's words inside the blocks taken, repeats included; it never exceeds ``limit``
    times the size. ``full_takes`` says how often the document's first word was taken, ``slots`` how many slots take
    words of it, and ``first_slot`` is the first of them (null if there is none): the place of the document in the mix.

    Running word sums are made per slice of the shuffled order and joined by the totals of the
    slices, so a source with a third of all rows is spread over thousands of windows.

    Null text has size 0; a null source is a source of its own; repeated rows are documents of
    their own that follow each other; an empty table gives no rows. Extra columns are not read.
    """
    size = word_count(F.col("text")) if size is None else size
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), "source", size.alias("size"), key.alias("_key"))
    return _planned(cut_lineage(rows), weights, share, limit).select(
        F.col("_id").alias(id_col), "source", "size", "source_size", "target", "taken", "full_takes", "first_slot", "slots"
    )


def _planned(rows: DataFrame, weights: list[int], share: float, limit: float) -> DataFrame:
    """The plan of stored rows (_row, _id, source, size, _key), with ``_firsts``, the slots that take the first word."""
    rows = rows.withColumn("_slice", F.substring("_key", 1, 3))
    slices = rows.groupBy("source", "_slice").agg(F.sum("size").alias("_words"))
    sizes = slices.groupBy("source").agg(F.sum("_words").alias("source_size"))
    layout = cut_lineage(block_layout(source_targets(sizes, weights, share, limit)))

    earlier = Window.partitionBy("source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slices.select(
        F.col("source").alias("_source"), F.col("_slice").alias("_of"), F.coalesce(F.sum("_words").over(earlier), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy("source", "_slice").orderBy("_key", "_id", "size", "_row").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        rows.withColumn("_before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(offsets, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_slice") == F.col("_of")))
        .withColumn("_start", F.col("_offset") + F.col("_before"))
        .drop("_source")
        .join(layout.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
        .select("_row", "_id", "source", "nr", "size", "source_size", "target", "block_words", "_start")
    )

    # words of its block that a slot takes: all, or what the source's target leaves
    first = F.floor(F.col("rank") / F.col("blocks")) * F.col("source_size") + F.col("_block") * F.col("block_words")
    whole = F.least("block_words", F.col("source_size") - F.col("_block") * F.col("block_words"))
    takes = (
        schedule(layout)
        .join(layout.select("nr", "blocks", "block_words", "source_size", "take_words"), "nr")
        .withColumn("_block", F.col("rank") % F.col("blocks"))
        .withColumn("_words", F.least(whole, F.col("take_words") - first))
        .filter("_words > 0")
        # a block is taken once a turn, at most twice at the default limit
        .groupBy("nr", "_block")
        .agg(F.collect_list(F.struct("slot", "_words")).alias("_takes"))
    )
    start, end, at = F.col("_start"), F.col("_start") + F.col("size"), F.col("_block") * F.col("block_words")
    blocks_of = F.sequence(F.floor(start / F.col("block_words")), F.floor(F.greatest(start, end - 1) / F.col("block_words")))
    none = F.array().cast("array<struct<slot:bigint,_words:bigint>>")
    held = lambda t: F.greatest(F.lit(0).cast("long"), F.least(end, at + t["_words"]) - F.greatest(start, at))
    pieces = (
        placed.withColumn("_block", F.explode(blocks_of))
        .join(takes, ["nr", "_block"], "left")
        .withColumn("_takes", F.coalesce("_takes", none))
        .withColumn("_taken", F.aggregate("_takes", F.lit(0).cast("long"), lambda s, t: s + held(t)))
        .withColumn("_slots", F.transform(F.filter("_takes", lambda t: held(t) > 0), lambda t: t["slot"]))
        .withColumn("_here", (at <= start) & (start < at + F.col("block_words")))
        .withColumn("_starts", F.when(F.col("_here"), F.transform(F.filter("_takes", lambda t: start < at + t["_words"]), lambda t: t["slot"])).otherwise(F.array().cast("array<bigint>")))
    )
    # only the block of the first word has starts, so one list is as long as the limit
    return (
        pieces.groupBy("_row")
        .agg(
            *[F.first(c).alias(c) for c in ("_id", "source", "size", "source_size", "target")], F.sum("_taken").alias("taken"),
            F.sum(F.size("_starts")).cast("int").alias("full_takes"), F.min(F.array_min("_slots")).alias("first_slot"),
            F.sum(F.size("_slots")).alias("slots"), F.max_by("_starts", F.size("_starts")).alias("_firsts"),
        )
    )


def mixed_documents(docs: DataFrame, weights: list[int], share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """The mix as whole documents in the order of its slots: each stands at every slot that takes its first word.

    Columns are those of ``docs``, whatever their names. Every row counts by itself, repeated rows and null ids too; rows
    without words are left out, as no slot takes them. The rows are stored once to give each an identity.
    """
    names = docs.columns
    private = [f"c{i}" for i in range(len(names))]
    held = cut_lineage(docs.select(F.monotonically_increasing_id().alias("_row"), *[docs[n].alias(p) for n, p in zip(names, private, strict=True)]))
    named = {n: F.col(p) for n, p in zip(names, private, strict=True)}
    key = F.md5(F.coalesce(named["doc_id"].cast("string"), F.lit("")))
    rows = cut_lineage(held.select("_row", named["doc_id"].alias("_id"), named["source"].alias("source"), word_count(named["text"]).alias("size"), key.alias("_key")))
    plan = _planned(rows, weights, share, limit).filter("full_takes > 0 and size > 0").select("_row", F.explode("_firsts").alias("_slot"))
    return held.join(plan, "_row").orderBy("_slot", "_row").select(*[F.col(p).alias(n) for n, p in zip(names, private, strict=True)])
