"""Masks as words: 64 texels of a pixel row in one long.

A word table has the keys of a mask (its texture, maybe a region), ``y``, ``w`` (x div 64) and ``bits``. Shapes become runs
of a pixel row, runs become words, and mask algebra is bit algebra on words that meet by an equi-join, so no shape is
compared with texels it does not cover and a shuffle moves one row where a texel table moves up to 64.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arithmetic import clip, div

WORD = 64
PLACE = ["y", "w"]


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


def _left(bits: Column, n: Column | int) -> Column:
    return F.call_function("shiftleft", bits, n if isinstance(n, Column) else F.lit(n))


def _right(bits: Column, n: Column | int) -> Column:
    return F.call_function("shiftrightunsigned", bits, n if isinstance(n, Column) else F.lit(n))


def _bits_between(low: Column, high: Column) -> Column:
    """A word with the bits low..high set (0 to 63)."""
    return _left(_right(_long(-1), (F.lit(WORD) - (high - low + 1)).cast("int")), low.cast("int"))


def _gathered(words: DataFrame, keys: list[str]) -> DataFrame:
    return words.groupBy(*keys, *PLACE).agg(F.bit_or("bits").alias("bits"))


def texel_words(mask: DataFrame, keys: list[str]) -> DataFrame:
    """Words of a mask of texels (keys, x, y)."""
    bit = _left(_long(1), (F.col("x") % WORD).cast("int"))
    return _gathered(mask.select(*keys, "y", div(F.col("x"), WORD).alias("w"), bit.alias("bits")), keys)


def run_words(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Words of runs (keys, y, first, last), both ends included; runs may overlap. A run with last < first is empty."""
    real = runs.filter("first <= last and first >= 0 and y >= 0")
    spread = real.withColumn("w", F.explode(F.sequence(div(F.col("first"), WORD), div(F.col("last"), WORD))))
    base = F.col("w") * WORD
    bits = _bits_between(F.greatest(F.col("first") - base, _long(0)), F.least(F.col("last") - base, _long(WORD - 1)))
    return _gathered(spread.select(*keys, *PLACE, bits.alias("bits")), keys)


def rectangle_runs(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of rectangles (keys, x0, y0, x1, y1), clipped at 0."""
    x0, y0 = (F.greatest(F.col(c).cast("long"), _long(0)) for c in ("x0", "y0"))
    real = boxes.filter("x1 > 0 and y1 > 0 and x1 > x0 and y1 > y0")
    return real.select(*keys, x0.alias("first"), (F.col("x1").cast("long") - 1).alias("last"), F.explode(F.sequence(y0, F.col("y1").cast("long") - 1)).alias("y"))


def polygon_runs(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of closed polygons (keys, x0, y0, x1, y1 of every edge) by the even-odd rule on texel centres.

    Every edge is spread over the pixel rows it crosses; the crossings of a row are sorted and taken in pairs. A last
    crossing without a partner, of an open line, opens no run.
    """
    low, high = F.least("y0", "y1"), F.greatest("y0", "y1")
    at = F.col("x0") + (F.col("y") + 0.5 - F.col("y0")) * (F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0"))
    crossed = edges.filter("y0 <> y1").withColumn("y", F.explode(F.sequence(low, high - 1))).select(*keys, "y", at.alias("at"))
    rows = crossed.groupBy(*keys, "y").agg(F.array_sort(F.collect_list("at")).alias("xs"))
    pairs = F.filter(
        F.transform("xs", lambda c, i: F.struct(i.alias("i"), c.alias("a"), F.get("xs", i + 1).alias("b"))), lambda p: (p["i"] % 2 == 0) & p["b"].isNotNull()
    )
    spans = rows.select(*keys, "y", F.explode(pairs).alias("p"))
    return spans.select(
        *keys, F.col("y").cast("long").alias("y"), F.greatest(F.ceil(F.col("p.a") - 0.5), _long(0)).alias("first"), (F.ceil(F.col("p.b") - 0.5) - 1).alias("last")
    )


def union_words(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    columns = [*keys, *PLACE, "bits"]
    return _gathered(left.select(*columns).unionByName(right.select(*columns)), keys)


def intersect_words(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Bits set in both; ``right`` may lack keys of ``left`` and then applies to all of them."""
    shared = [k for k in keys if k in right.columns] + PLACE
    met = left.join(right.select(*shared, F.col("bits").alias("_other")), shared)
    return met.select(*keys, *PLACE, F.col("bits").bitwiseAND(F.col("_other")).alias("bits")).filter("bits <> 0")


def subtract_words(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Bits of ``left`` that are not set in ``right``, which may lack keys of ``left``."""
    shared = [k for k in keys if k in right.columns] + PLACE
    met = left.join(right.select(*shared, F.col("bits").alias("_other")), shared, "left")
    rest = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("_other", _long(0))))
    return met.select(*keys, *PLACE, rest.alias("bits")).filter("bits <> 0")


def _smeared(bits: Column, reach: int, shift) -> Column:
    """``bits`` or-ed with its shifts by 1 to ``reach``."""
    done = 0
    while done < reach:
        step = min(done + 1, reach - done)
        bits = bits.bitwiseOR(shift(bits, step))
        done += step
    return bits


def dilate_words(words: DataFrame, keys: list[str], radius: int, width: int, height: int) -> DataFrame:
    """Square dilation, clipped to the picture.

    Along x a word sends its neighbours the bits that leave it, along y it is sent to the rows in reach; both steps
    combine words before the shuffle. A radius over 32 is made of several dilations along x.
    """
    out, left = words, radius
    b = F.col("bits")
    while left > 0:
        r = min(left, 32)
        left -= r
        parts = F.array(
            F.struct(F.col("w").alias("w"), _smeared(b, r, _left).bitwiseOR(_smeared(b, r, _right)).alias("bits")),
            F.struct((F.col("w") - 1).alias("w"), _smeared(_left(b, WORD - r), r - 1, _left).alias("bits")),
            F.struct((F.col("w") + 1).alias("w"), _smeared(_right(b, WORD - r), r - 1, _right).alias("bits")),
        )
        sent = out.select(*keys, "y", F.inline(parts)).filter(f"bits <> 0 and w >= 0 and w <= {(width - 1) // WORD}")
        out = _gathered(sent, keys)
    inside = F.when(F.col("w") == (width - 1) // WORD, b.bitwiseAND(_bits_between(_long(0), _long((width - 1) % WORD)))).otherwise(b)
    rows = F.sequence(F.greatest(F.col("y") - radius, _long(0)), F.least(F.col("y") + radius, _long(height - 1)))
    real = out.withColumn("bits", inside).filter(f"bits <> 0 and y >= {-radius} and y < {height + radius}")
    return _gathered(real.withColumn("y", F.explode(rows)), keys)


def word_texels(words: DataFrame, keys: list[str]) -> DataFrame:
    """The set texels (keys, x, y) of words."""
    places = F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda i: _right(F.col("bits"), i).bitwiseAND(_long(1)) == 1)
    return words.select(*keys, "y", "w", F.explode(places).alias("_i")).select(*keys, (F.col("w") * WORD + F.col("_i")).alias("x"), "y")


# ---- shares of boxes -------------------------------------------------------


def box_mask_shares(boxes: DataFrame, flags: DataFrame, masks: list[str], width: int, height: int) -> DataFrame:
    """Share of each clipped box that is set in each of several masks, all in one pass.

    ``boxes``: texture_id, box_id, x0, y0, x1, y1; ``flags``: texture_id, x, y and a boolean per mask. Tiles of 64 x 64
    texels hold a word per row and mask. The tiles wholly inside a box come as four lookups in the running sums of the
    tiles' counts; the tiles on its border are counted from their words. A box without area has the share 0.
    """
    key = ["texture_id", "tx", "ty"]
    box = ["texture_id", "box_id"]
    clipped = boxes.select(*box, *[clip(F.col(c).cast("long"), _long(0), _long(limit)).alias(c) for c, limit in (("x0", width), ("y0", height), ("x1", width), ("y1", height))])
    set_bit = _left(_long(1), (F.col("x") % WORD).cast("int"))
    words = flags.groupBy("texture_id", div(F.col("x"), WORD).alias("tx"), "y").agg(
        *[F.bit_or(F.when(F.col(m), set_bit).otherwise(_long(0))).alias(m) for m in masks]
    )
    tiles = words.groupBy("texture_id", "tx", div(F.col("y"), WORD).alias("ty")).agg(
        F.collect_list(F.struct((F.col("y") % WORD).alias("r"), *masks)).alias("rows"),  # 64 rows at most
        *[F.sum(F.bit_count(m)).cast("long").alias(f"n_{m}") for m in masks],
    )
    # running sums of the tiles' counts, along x and then along y: a picture has few tiles
    last_x, last_y = (width - 1) // WORD, (height - 1) // WORD
    grid = tiles.select("texture_id").distinct().select("texture_id", F.explode(F.sequence(_long(0), _long(last_x))).alias("tx")).select(
        "*", F.explode(F.sequence(_long(0), _long(last_y))).alias("ty")
    )
    dense = grid.join(tiles.drop("rows"), key, "left").fillna(0, [f"n_{m}" for m in masks])
    for along, across in (("tx", "ty"), ("ty", "tx")):
        up_to = Window.partitionBy("texture_id", across).orderBy(along).rowsBetween(Window.unboundedPreceding, 0)
        dense = dense.withColumns({f"n_{m}": F.sum(f"n_{m}").over(up_to) for m in masks})

    real = clipped.filter("x1 > x0 and y1 > y0").select(
        "*",
        *[F.ceil(F.col(f"{a}0") / WORD).alias(f"{a}_from") for a in "xy"],
        *[div(F.col(f"{a}1"), WORD).alias(f"{a}_to") for a in "xy"],
    )
    whole = (F.col("x_from") < F.col("x_to")) & (F.col("y_from") < F.col("y_to"))
    corners = F.array(*[
        F.struct((F.col(f"x_{a}") - 1).alias("tx"), (F.col(f"y_{b}") - 1).alias("ty"), _long(1 if a == b else -1).alias("sign"))
        for a in ("from", "to") for b in ("from", "to")
    ])
    inner = real.filter(whole).select(*box, F.inline(corners)).filter("tx >= 0 and ty >= 0").join(dense, key)
    inner_hits = inner.select(*box, *[(F.col("sign") * F.col(f"n_{m}")).alias(m) for m in masks])

    first, last = div(F.col("x0"), WORD), div(F.col("x1") - 1, WORD)
    rows = real.withColumn("ty", F.explode(F.sequence(div(F.col("y0"), WORD), div(F.col("y1") - 1, WORD))))
    ends = F.array_compact(F.array(F.when(first < F.col("x_from"), first), F.when((last >= F.col("x_to")) & ((last > first) | (first >= F.col("x_from"))), last)))
    through = whole & (F.col("ty") >= F.col("y_from")) & (F.col("ty") < F.col("y_to"))
    border = rows.withColumn("tx", F.explode(F.when(through, ends).otherwise(F.sequence(first, last))))
    left, right = F.greatest(F.col("x0") - F.col("tx") * WORD, _long(0)), F.least(F.col("x1") - F.col("tx") * WORD, _long(WORD)) - 1
    top, bottom = F.col("y0") - F.col("ty") * WORD, F.col("y1") - F.col("ty") * WORD
    met = border.join(tiles.select(*key, "rows"), key).withColumns({"_bits": _bits_between(left, right), "_top": top, "_bottom": bottom})
    taken = F.filter("rows", lambda r: (r["r"] >= F.col("_top")) & (r["r"] < F.col("_bottom")))

    def counted(m: str) -> Column:
        return F.aggregate("_rows", _long(0), lambda n, r: n + F.bit_count(r[m].bitwiseAND(F.col("_bits"))))

    border_hits = met.withColumn("_rows", taken).select(*box, *[counted(m).alias(m) for m in masks])
    hits = inner_hits.unionByName(border_hits).groupBy(*box).agg(*[F.sum(m).alias(m) for m in masks])
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    share = {m: F.when(area > 0, F.coalesce(m, _long(0)) / area).otherwise(0.0) for m in masks}
    return clipped.join(hits, box, "left").select(*box, *[v.alias(m) for m, v in share.items()])
