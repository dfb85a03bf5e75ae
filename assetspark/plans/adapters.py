"""Domain tables derived from the driver tables.

Every adapter has a twin of the same name in ``adapters_sql``; both must build
the same rows.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arithmetic import div
from ..operators import mips

# Vocabularies of the synthetic readings.
DETECTION_WORDS = ["WARNING", "STOP", "A", "12", "", "BEER", "AB"]
READING_WORDS = ["Nutrition Facts", "Facts", "NUTRITION", "Beer", "12", "beer", "Stop"]
TEXTURE_ENDINGS = ["_d", "_n", "_g", "_diff", "_nrm", "_lod0_gloss", ""]
SLOT_PROPERTIES = [
    "_MainTex", "_BumpMap", "_SpecMap", "_BaseMap", "_NormalMap", "_GlossMap", "_Detail",
]
REVIEW_DECISIONS = ["confirmed", "probable", "needs_review", "rejected", "clear"]
STAGE_STATUS = ["pass", "fail", "pending"]


def pick(values: list, index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index)


class Tables:
    """Lazy access to the driver tables of one scale factor and their adapters."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.read(name)

    # ---- readings ---------------------------------------------------------
    @cached_property
    def events_k(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("int")
        return self.read("events").withColumn("k", k)

    @cached_property
    def detections(self) -> DataFrame:
        return self.events_k.select(
            div(F.col("event_id"), 3).alias("asset_id"),
            F.col("event_id").alias("seq"),
            pick(DETECTION_WORDS, F.col("k") % 7).alias("text"),
            F.least(F.lit(1.0), F.round(F.col("value") / 100, 6)).alias("confidence"),
            F.col("event_type").alias("engine"),
            F.concat(F.lit("v"), F.col("k") % 4).alias("variant"),
        )

    @cached_property
    def readings(self) -> DataFrame:
        """Boxes on a 400x400 canvas, so that readings of an image overlap."""
        e = F.col("event_id")
        x0, y0 = (e * 37) % 400, (e * 91) % 400
        return self.events_k.select(
            F.col("user_id").alias("image_id"),
            e.alias("seq"),
            pick(READING_WORDS, F.col("k") % 7).alias("text"),
            F.when(F.col("k") % 7 == 4, "other").otherwise("latin").alias("script"),
            F.least(F.lit(1.0), F.round(F.col("value") / 50, 6)).alias("confidence"),
            F.col("event_type").alias("engine"),
            F.concat("event_type", F.lit("-m"), F.col("k") % 2).alias("model_signature"),
            F.concat(F.lit("v"), F.col("k") % 3).alias("variant"),
            (F.lit(90) * (F.col("k") % 4)).alias("rotation_deg"),
            x0.alias("x0"),
            y0.alias("y0"),
            (x0 + 60 + F.col("k") % 30).alias("x1"),
            (y0 + 40 + F.col("k") % 10).alias("y1"),
        )

    @cached_property
    def region_calls(self) -> DataFrame:
        """Tokens of one recognizer call on one region (eight events per call)."""
        e = F.col("event_id")
        slot = e % 8
        return self.events_k.select(
            div(e, 8).alias("call_id"),
            div(e, 16).alias("region_id"),
            e.alias("seq"),
            pick(READING_WORDS, F.col("k") % 7).alias("text"),
            F.least(F.lit(1.0), F.round(F.col("value") / 50, 6)).alias("confidence"),
            F.col("event_type").alias("engine"),
            F.concat("event_type", F.lit("-m"), F.col("k") % 2).alias("model_signature"),
            F.concat(F.lit("v"), div(e, 8) % 2).alias("variant"),
            (slot * 50 + F.col("k") % 20).cast("double").alias("cx"),
            (div(slot, 3) * 18 + F.col("k") % 5).cast("double").alias("cy"),
            (F.lit(10) + F.col("k") % 6).cast("double").alias("height"),
        )

    @cached_property
    def review_log(self) -> DataFrame:
        return self.events_k.select(
            F.col("user_id").alias("asset_id"),
            pick(REVIEW_DECISIONS, F.col("k") % 5).alias("decision"),
            F.col("event_type").alias("reviewer"),
            F.col("ts").alias("reviewed_at"),
        )

    @cached_property
    def stage_log(self) -> DataFrame:
        return self.events_k.select(
            F.col("user_id").alias("target_id"),
            F.col("event_type").alias("stage"),
            pick(STAGE_STATUS, F.col("k") % 3).alias("status"),
            F.sha2(F.col("event_id").cast("string"), 256).alias("evidence_sha256"),
            "ts",
        )

    @cached_property
    def regions(self) -> DataFrame:
        """Approved regions: one per event, grouped into targets by user."""
        e = F.col("event_id")
        return self.events_k.select(
            F.col("user_id").alias("target_id"),
            e.alias("region_id"),
            pick(READING_WORDS, F.col("k") % 7).alias("text"),
            (F.col("k") % 3 + 1).alias("occurrences"),
            F.when(F.col("k") % 5 < 3, F.col("k") % 5 == 0).alias("ocr_required"),
            (F.col("k") % 2 == 0).alias("needs_ocr_fallback"),
            pick(["front", "back", "side"], F.col("k") % 3).alias("face"),
            (F.lit(90) * (F.col("k") % 4)).alias("rotation_deg"),
            (e % 300).alias("x0"),
            (e * 7 % 300).alias("y0"),
            (e % 300 + 20 + F.col("k") % 120).alias("x1"),
            (e * 7 % 300 + 20 + F.col("k") % 90).alias("y1"),
        )

    # ---- sources and texts ------------------------------------------------
    @cached_property
    def texture_names(self) -> DataFrame:
        p = F.col("p_partkey")
        return self.read("part").select(
            p.alias("path_id"),
            F.concat(
                F.replace(F.col("p_name"), F.lit(" "), F.lit("_")),
                pick(TEXTURE_ENDINGS, p % 7),
            ).alias("texture"),
            F.concat(
                pick(["assets/items/", "assets/usable_items/", "assets/maps/", "other/"], p % 4),
                F.lower(F.replace(F.col("p_brand"), F.lit("#"), F.lit("_"))),
            ).alias("bundle_key"),
            F.when(p % 11 == 0, F.lit("item")).when(p % 13 == 0, F.lit("map")).alias("asset_type"),
            F.when(p % 3 == 0, F.lower("p_type")).alias("category"),
            F.when(p % 5 == 0, F.concat(F.lit("scene"), p % 9)).alias("map"),
        )

    @cached_property
    def manifest(self) -> DataFrame:
        """Manifest records: image path, metadata; documents give exact copies."""
        d = F.col("doc_id")
        return self.read("documents").select(
            d.alias("record_id"),
            F.when(d % 17 != 0, F.concat(F.lit("img/"), F.substring(F.md5("text"), 1, 8), F.lit(".png"))).alias("path"),
            F.col("source").alias("category"),
            F.col("lang").alias("asset_group"),
            F.sha2("text", 256).alias("pixel_sha256"),
            "text",
        )

    # ---- graph ------------------------------------------------------------
    @cached_property
    def slots(self) -> DataFrame:
        return self.read("lineitem").select(
            F.concat(F.lit("mat/"), F.col("l_orderkey") % 50).alias("bundle_key"),
            F.col("l_orderkey").alias("material_path_id"),
            pick(SLOT_PROPERTIES, F.col("l_linenumber") - 1).alias("property"),
            F.concat(F.lit("tex/"), F.col("l_suppkey") % 20).alias("texture_bundle_key"),
            (F.col("l_partkey") % 500 + 1).alias("path_id"),
            (F.lit(1.0) + F.col("l_discount")).alias("scale_u"),
            F.lit(1.0).alias("scale_v"),
            F.col("l_tax").alias("offset_u"),
            F.lit(0.0).alias("offset_v"),
        )

    @cached_property
    def raw_slots(self) -> DataFrame:
        """Slots with the file of their material and the pointer as it is stored."""
        file_id = F.col("path_id") % 3
        return self.slots.withColumns(
            {
                "assets_file": F.concat(F.lit("cab-"), F.col("material_path_id") % 4),
                "file_id": file_id,
                "external_assets_file": F.when(file_id > 0, F.concat(F.lit("archive:/"), F.col("texture_bundle_key"))),
            }
        )

    @cached_property
    def raw_materials(self) -> DataFrame:
        """Materials with their files: one per order, and one without slots per customer."""
        order, customer = F.col("o_orderkey"), -F.col("c_custkey")

        def rows(table: DataFrame, key: Column) -> DataFrame:
            return table.select(
                F.concat(F.lit("mat/"), F.abs(key) % 50).alias("bundle_key"), F.concat(F.lit("cab-"), F.abs(key) % 4).alias("assets_file"),
                key.alias("material_path_id"),
            )

        return rows(self.read("orders"), order).unionByName(rows(self.read("customer"), customer))

    @cached_property
    def targets(self) -> DataFrame:
        path_id = F.col("p_partkey") % 500 + 1
        bundle = F.concat(F.lit("tex/"), F.col("p_partkey") % 20)
        return (
            self.read("part")
            .filter("p_size <= 5")
            .select(
                bundle.alias("texture_bundle_key"),
                path_id.alias("path_id"),
                F.concat(F.lit("t"), path_id, bundle).alias("target_id"),
            )
            .distinct()
        )

    @cached_property
    def deps(self) -> DataFrame:
        customer = self.read("customer").select("c_custkey", "c_nationkey")
        orders = self.read("orders").select("o_custkey")
        return (
            orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
            .select(
                F.concat(F.lit("mat/"), F.col("o_custkey") % 50).alias("bundle_key"),
                F.concat(F.lit("tex/"), F.col("c_nationkey") % 20).alias("depends_on"),
            )
            .distinct()
        )

    # ---- pixels -----------------------------------------------------------
    @cached_property
    def texels(self) -> DataFrame:
        """16x16 RGBA textures: sixteen vectors are the rows of one texture."""
        base = self.read("embeddings").select(
            div(F.col("vec_id"), 16).alias("texture_id"),
            (F.col("vec_id") % 16).alias("y"),
            F.explode(F.sequence(F.lit(0), F.lit(15))).alias("x"),
            "embedding",
        )

        def channel(k: int) -> Column:
            v = F.get("embedding", F.col("x") * 4 + k).cast("double")
            scaled = F.least(F.lit(255.0), F.greatest(F.lit(0.0), (v + 1) * 127.5))
            return F.floor(scaled + 0.5)

        return base.select(
            "texture_id",
            F.col("x").cast("long"),
            F.col("y").cast("long"),
            *[channel(k).alias(c) for k, c in enumerate("rgba")],
        )

    @cached_property
    def texture_sizes(self) -> DataFrame:
        """Sizes of ``texels``: always 16x16, also where rows of a texture are missing."""
        side = F.lit(16).cast("long")
        textures = self.read("embeddings").select(div(F.col("vec_id"), 16).alias("texture_id")).distinct()
        return textures.select("texture_id", side.alias("width"), side.alias("height"))

    @cached_property
    def odd_texels(self) -> DataFrame:
        """The same texels, 105 of them a picture of 15x7, 5x21, 1x105 or 35x3."""
        place = F.col("texture_id") * 256 + F.col("y") * 16 + F.col("x")
        i = F.col("place") % 105
        width = pick([15, 5, 1, 35], F.col("picture") % 4)
        return (
            self.texels.select(place.alias("place"), div(place, 105).alias("picture"), "r", "g", "b", "a")
            .withColumn("width", width.cast("long"))
            .select(F.col("picture").alias("texture_id"), (i % F.col("width")).alias("x"), div(i, F.col("width")).alias("y"), "r", "g", "b", "a")
        )

    @cached_property
    def edited_texels(self) -> DataFrame:
        hit = (F.col("x") + F.col("y")) % 5 == 0
        return self.texels.withColumn("r", F.when(hit, (F.col("r") + 17) % 256).otherwise(F.col("r")))

    @staticmethod
    def mask_flags(df: DataFrame) -> DataFrame:
        """Mask membership as flags beside each texel."""
        x, y = F.col("x"), F.col("y")
        editable = ((x + y) % 5 == 0) | (x < 4)
        return df.withColumns(
            {
                "editable": editable,
                "protected": ~editable,
                "seam_guard": (x == 15) & ~editable,
                "old_text": (x + y) % 10 == 0,
                "new_text": (x + y) % 15 == 0,
                "covered": (x - 8) * (x - 8) + (y - 8) * (y - 8) <= 49,
            }
        )

    @cached_property
    def mask_texels(self) -> DataFrame:
        return self.mask_flags(self.texels.select("texture_id", "x", "y"))

    def mask(self, name: str) -> DataFrame:
        return self.mask_texels.filter(F.col(name)).select("texture_id", "x", "y")

    @cached_property
    def effect_levels(self) -> DataFrame:
        """Intended and compressed versions of a neutralized and relettered map.

        Level 0 is the texture, level 1 its next mip with the flags of any texel of a block. Channels G and A are
        the selected ones; ``is``/``in``/``ie`` are the intended source, neutral
        and edited values, ``as``/``an``/``ae`` the decoded ones.
        """
        flagged = self.mask_flags(self.texels)
        block = [F.col("texture_id"), div(F.col("x"), 2).alias("x"), div(F.col("y"), 2).alias("y")]
        flags = [c for c in flagged.columns if c not in self.texels.columns]
        marks = flagged.groupBy(*block).agg(*[F.bool_or(c).alias(c) for c in flags])
        level1 = mips.next_level(self.texels, "gloss", self.texture_sizes).join(marks, ["texture_id", "x", "y"]).withColumn("level", F.lit(1))
        both = flagged.withColumn("level", F.lit(0)).unionByName(level1)
        noise = (F.col("x") * 7 + F.col("y") * 3) % 5 - 2

        def clip(c: Column) -> Column:
            return F.least(F.lit(255), F.greatest(F.lit(0), c))

        out = both
        for ch in "ga":
            neutral = F.when(F.col("old_text"), F.lit(128)).otherwise(F.col(ch))
            edited = F.when(F.col("new_text"), clip(neutral + 40)).otherwise(neutral)
            out = out.withColumns(
                {
                    f"is_{ch}": F.col(ch),
                    f"in_{ch}": neutral.cast("long"),
                    f"ie_{ch}": edited.cast("long"),
                    f"as_{ch}": clip(F.col(ch) + noise).cast("long"),
                    f"an_{ch}": clip(neutral + noise).cast("long"),
                    f"ae_{ch}": clip(edited + noise + F.when(F.col("new_text"), noise).otherwise(0)).cast("long"),
                }
            )
        return out

    # ---- meshes and ranges ------------------------------------------------
    @cached_property
    def mesh_triangles(self) -> DataFrame:
        return self.read("lineitem").select(
            (F.col("l_suppkey") % 10).alias("mesh"),
            (F.col("l_linenumber") % 3).alias("submesh"),
            F.col("l_partkey").alias("a"),
            (F.lit(100000) + F.col("l_suppkey")).alias("b"),
            (F.lit(200000) + F.col("l_orderkey") % 5000).alias("c"),
        )

    @cached_property
    def uv_triangles(self) -> DataFrame:
        """Small triangles in a repeat-wrapped unit square, one per part."""
        p = F.col("p_partkey")
        return self.read("part").select(
            (p % 8).alias("mesh"),
            p.alias("tri"),
            ((p * 37 % 1000) / 1000 - 0.2).alias("ua"),
            ((p * 91 % 1000) / 1000 - 0.1).alias("va"),
            ((p * 37 % 1000) / 1000 - 0.2 + (p % 7 + 2) / 50).alias("ub"),
            ((p * 91 % 1000) / 1000 - 0.1 + (p % 3) / 50).alias("vb"),
            ((p * 37 % 1000) / 1000 - 0.2 + (p % 5) / 50).alias("uc"),
            ((p * 91 % 1000) / 1000 - 0.1 + (p % 4 + 2) / 50).alias("vc"),
        )

    @cached_property
    def vertices(self) -> DataFrame:
        """Vertices with near-equal positions, as stored by split normals."""
        p = F.col("p_partkey")
        return self.read("part").select(
            (p % 8).alias("mesh"),
            p.alias("vid"),
            ((p * 13 % 400) / 8 + (p % 3 - 1) * 1e-7 + F.when(p % 7 < 3, div(p, 400) * 60.0).otherwise(0.0)).alias("px"),
            ((p * 7 % 20) / 4).alias("py"),
            (p % 2).cast("double").alias("pz"),
            ((p * 5 % 16) / 16).alias("u"),
            ((p * 3 % 8) / 8).alias("v"),
        )

    @cached_property
    def vertex_triangles(self) -> DataFrame:
        p = F.col("p_partkey")
        return self.read("part").select(
            (p % 8).alias("mesh"),
            (div(p, 8) % 2).alias("submesh"),
            p.alias("tri"),
            p.alias("a"),
            (p + 8).alias("b"),
            (p + 24).alias("c"),
        )

    @cached_property
    def intervals(self) -> DataFrame:
        return self.read("lineitem").select(
            F.col("l_suppkey").alias("grp"),
            (F.col("l_partkey") * 10).alias("start"),
            (F.col("l_partkey") * 10 + F.col("l_quantity").cast("long")).alias("end"),
        )

    # ---- hash-pinned artifacts --------------------------------------------
    @cached_property
    def recorded_artifacts(self) -> DataFrame:
        return self.read("orders").select(
            F.concat(F.lit("a/"), F.col("o_orderkey")).alias("path"),
            F.concat(F.lit("t"), F.col("o_custkey")).alias("target_id"),
            F.sha2(F.concat("o_orderstatus", "o_orderkey"), 256).alias("sha256"),
        )

    @cached_property
    def current_artifacts(self) -> DataFrame:
        k = F.col("o_orderkey")
        changed = F.when(k % 97 == 0, F.lit("x")).otherwise(F.lit(""))
        return (
            self.read("orders")
            .filter(k % 89 != 0)
            .select(
                F.concat(F.lit("a/"), k).alias("path"),
                F.sha2(F.concat("o_orderstatus", k, changed), 256).alias("sha256"),
            )
        )
