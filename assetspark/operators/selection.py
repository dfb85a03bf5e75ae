"""Asset selection: metadata rules, dedup, classification, reviews, reports."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arithmetic import count_where
from ..functions.ids import asset_id, field_text, sha256_hex
from ..functions.text import agreement_text, casefold, is_blank, nfc, script_letters, similarity
from ..session import cut_lineage

# Token lists of the name filter.
COLOR_TOKENS = ["d", "diff", "diffuse", "albedo", "basecolor", "base", "color", "colour"]
NON_COLOR_TOKENS = [
    "n", "nrm", "normal", "g", "gloss", "spec", "specular", "mask", "metallic", "rough",
    "roughness", "ao", "height",
]
# Tiers.
CANDIDATE_TIERS = ["confirmed", "probable", "needs_review"]
REVIEWABLE = ["confirmed", "probable", "needs_review", "rejected"]
TIER_ORDER = ["confirmed", "probable", "needs_review", "rejected"]


@dataclass(frozen=True)
class Thresholds:
    """Default classification thresholds."""

    confirmed_score: float = 0.80
    probable_score: float = 0.45
    review_score: float = 0.15
    agreement_score: float = 0.45
    agreement_similarity: float = 0.80
    confirmed_letters: int = 3
    probable_letters: int = 2


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _filled(value: Column) -> Column:
    return value.isNotNull() & (value != "")


# ---- metadata rules -------------------------------------------------------


def first_non_blank(*candidates: Column) -> Column:
    """First field that holds more than white space."""
    return F.coalesce(*[F.when(~is_blank(c), c) for c in candidates])


def item_key(key: Column) -> Column:
    return F.lower(key).rlike("/(usable_)?items/")


def asset_type(explicit: Column, key: Column, scene: Column) -> Column:
    return (
        F.when(explicit.isin("item", "map"), explicit)
        .when(item_key(key), "item")
        .when(_filled(scene), "map")
        .otherwise("unknown")
    )


def normalized_metadata(record: Column) -> Column:
    """struct<bundle_key, texture_name, asset_type, groups> of a manifest record (a map of texts).

    The bundle key falls back to ``key``, the texture name to ``texture``; a present field wins even if it is blank. The
    type rule also reads ``assetType``, ``source`` in place of a key, and a scene from ``scene``, ``scene_path`` or ``map``.
    """
    def first_present(*names: str) -> Column:
        out = F.lit(None).cast("string")
        for name in reversed(names):
            out = F.when(F.map_contains_key(record, name), record[name]).otherwise(out)
        return out

    scene = F.coalesce(*[F.when(_filled(record[name]), record[name]) for name in ("scene", "scene_path", "map")])
    listed = F.from_json(record["groups"], "array<string>")
    given = F.when(record["groups"].rlike(r"^\s*\["), listed).when(record["groups"].isNotNull(), F.array(record["groups"]))
    return F.struct(
        first_present("bundle_key", "key").alias("bundle_key"),
        first_present("texture_name", "texture").alias("texture_name"),
        asset_type(first_present("asset_type", "assetType"), first_present("bundle_key", "key", "source"), scene).alias("asset_type"),
        groups(given, record["map"], record["category"]).alias("groups"),
    )


def bundle_asset_type(explicit: Column, key: Column) -> Column:
    """Rule for bundles: anything that is not an item belongs to a map."""
    return (
        F.when(explicit.isin("item", "map"), explicit)
        .when(item_key(key), "item")
        .otherwise("map")
    )


def groups(explicit: Column, map_name: Column, category: Column) -> Column:
    """Explicit groups first, then map and category unless already present."""
    given = F.filter(F.coalesce(explicit, F.array().cast("array<string>")), lambda g: ~is_blank(g))
    extra = F.array_distinct(
        F.array_compact(F.array(F.when(_filled(map_name), map_name), F.when(_filled(category), category)))
    )
    return F.concat(given, F.filter(extra, lambda v: ~F.array_contains(given, v)))


def name_tokens(name: Column) -> Column:
    return F.filter(F.split(F.lower(name), "[^a-z0-9]+"), lambda t: t != "")


def color_skip_reason(name: Column) -> Column:
    """Null for a color texture, else why it is skipped."""
    tokens = name_tokens(name)
    last = F.try_element_at(tokens, F.lit(-1))
    tail = F.slice(tokens, F.greatest(F.size(tokens) - 1, F.lit(1)), F.lit(2))
    return (
        F.when(last.isNull() | last.isin(COLOR_TOKENS), F.lit(None).cast("string"))
        .when(last.isin(NON_COLOR_TOKENS), F.concat(F.lit("non_color_suffix:"), last))
        .when(F.arrays_overlap(tail, _strings(NON_COLOR_TOKENS)), "non_color_token")
    )


def texture_role(name: Column) -> Column:
    low = F.lower(name)
    return (
        F.when(low.rlike("_n$|nrm|normal"), "normal")
        .when(low.rlike("_g$|gloss|smooth"), "gloss")
        .when(low.rlike("_d$|diff|albedo|basecolor"), "diffuse")
        .otherwise("other")
    )


# Endings that a texture's family leaves out.
FAMILY_ENDINGS = ["_lod0_diff", "_lod0_nrm", "_lod0_gloss", "_diff", "_nrm", "_gloss", "_d", "_n", "_g"]


def texture_family(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), f"({'|'.join(FAMILY_ENDINGS)})$", "")


def ignored_diffuse(name: Column, tokens: list[str]) -> Column:
    low = F.lower(name)
    hits = F.exists(_strings([t.lower() for t in tokens]), lambda t: F.contains(low, t))
    return (texture_role(name) == "diffuse") & hits


def effective_tier(decision: Column, tier: Column) -> Column:
    return F.coalesce(F.nullif(decision, F.lit("")), tier, F.lit("unknown"))


# ---- discovery ------------------------------------------------------------


def split_missing(manifest: DataFrame, listing: DataFrame, path: str = "path") -> tuple[DataFrame, DataFrame]:
    """Manifest rows whose image exists, and reason rows for the others."""
    known = listing.select(F.col(path).alias("_listed")).distinct()
    joined = manifest.join(known, F.col(path) == F.col("_listed"), "left")
    found = joined.filter(F.col("_listed").isNotNull()).drop("_listed")
    reason = F.when(F.col(path).isNull(), "manifest_image_field_missing").otherwise("image_missing")
    missing = joined.filter(F.col("_listed").isNull()).withColumn("reason", reason).drop("_listed")
    return found, missing


def drop_exact_copies(records: DataFrame, path: str, metadata: list[str]) -> DataFrame:
    """One row per (path, metadata) with the number of identical records.

    Grouping on one hash keeps the shuffle narrow and combines copies map-side.
    """
    key = sha256_hex(
        F.concat(
            F.lower(F.col(path)),
            F.lit("\0"),
            F.to_json(F.struct(*sorted(metadata)), {"ignoreNullFields": "false"}),
        )
    )
    firsts = [F.any_value(c).alias(c) for c in [path, *metadata]]
    return records.groupBy(key.alias("record_key")).agg(*firsts, F.count("*").alias("copies"))


def union_listing(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """Manifest rows plus the listed files no manifest row names (case-blind)."""
    named = manifest.select(F.lower("path").alias("_low")).distinct()
    extra = listing.join(named, F.lower(F.col("path")) == F.col("_low"), "left_anti")
    return manifest.select("path").distinct().withColumn("origin", F.lit("manifest")).unionByName(
        extra.select("path").distinct().withColumn("origin", F.lit("folder"))
    )


def pixel_groups(sources: DataFrame) -> DataFrame:
    """One row per distinct picture; the references stay rows of ``sources``.

    ``sources`` has path, source_id, pixel_sha256. Only a fixed-size state is
    kept per picture, so a picture with a third of all copies is no problem.
    """
    order = F.struct(F.lower("path"), F.col("source_id"))
    return (
        sources.groupBy("pixel_sha256")
        .agg(
            F.min_by(F.struct("path", "source_id"), order).alias("rep"),
            F.count("*").alias("reference_count"),
        )
        .select(
            asset_id(F.col("pixel_sha256")).alias("asset_id"),
            "pixel_sha256",
            F.col("rep.path").alias("representative_path"),
            F.col("rep.source_id").alias("representative_id"),
            "reference_count",
        )
    )


def limit_groups(candidates: DataFrame, limit: int) -> DataFrame:
    """Sources processed when a run stops after ``limit`` distinct pictures.

    Sources are walked in (lower path, source_id) order. The walk stops at the
    first source that finds ``limit`` pictures already seen, so the cut is a
    single order key: no global running count is needed.
    """
    order = F.struct(F.lower(F.col("path")).alias("p"), F.col("source_id").alias("s"))
    keyed = candidates.withColumn("_order", order)
    firsts = keyed.groupBy("pixel_sha256").agg(F.min("_order").alias("_first"))
    last = firsts.orderBy("_first").limit(limit).agg(
        F.max("_first").alias("_last"), F.count("*").alias("_n")
    )
    # both right sides are one-row aggregates, joined on a constant key
    one = F.lit(1).alias("_one")
    keyed = keyed.withColumn("_one", F.lit(1))
    cut = keyed.join(F.broadcast(last.select("*", one)), "_one").agg(
        F.min(
            F.when((F.col("_n") == limit) & (F.col("_order") > F.col("_last")), F.col("_order"))
        ).alias("_cut")
    )
    return (
        keyed.join(F.broadcast(cut.select("*", one)), "_one")
        .filter(F.col("_cut").isNull() | (F.col("_order") < F.col("_cut")))
        .drop("_order", "_cut", "_one")
    )


def plan_counts(sources: DataFrame) -> DataFrame:
    """Long table of plan counters from (asset_type, skip_reason)."""
    by_type = sources.groupBy(F.col("asset_type").alias("name")).agg(F.count("*").alias("n")).select(
        F.lit("asset_type").alias("counter"), "name", "n"
    )
    by_reason = (
        sources.filter("skip_reason is not null")
        .groupBy(F.col("skip_reason").alias("name"))
        .agg(F.count("*").alias("n"))
        .select(F.lit("skip_reason").alias("counter"), "name", "n")
    )
    totals = sources.agg(
        F.count("*").alias("total_sources"),
        count_where(F.col("skip_reason").isNull()).alias("color_candidates"),
        F.count("skip_reason").alias("skipped_non_color"),
    ).unpivot([], ["total_sources", "color_candidates", "skipped_non_color"], "name", "n").select(
        F.lit("total").alias("counter"), "name", "n"
    )
    return totals.unionByName(by_type).unionByName(by_reason)


# ---- classification -------------------------------------------------------


def with_letters(detections: DataFrame) -> DataFrame:
    """Adds latin, cyrillic and letters; each step is its own projection."""
    staged = detections.withColumn("_nfc", nfc(F.col("text"))).withColumn("_s", script_letters(F.col("_nfc")))
    return (
        staged.withColumns({"latin": F.col("_s.latin"), "cyrillic": F.col("_s.cyrillic")})
        .withColumn("letters", F.col("latin") + F.col("cyrillic"))
        .drop("_s", "_nfc")
    )


def _prefix_tokens(text: Column, threshold: float) -> Column:
    """Rare-first character occurrences that similar texts must share.

    A ratio of at least t needs t*(a+b)/2 common characters. With character
    occurrences put in one fixed order, two such texts share one of the first
    ``len - ceil(t/(2-t)*len) + 1`` entries.
    """
    chars = F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))
    # one (count rank, character) entry per occurrence; high ranks are rare
    entries = F.flatten(
        F.transform(
            chars,
            lambda c: F.transform(
                F.sequence(F.lit(1), F.length(text) - F.length(F.replace(text, c, F.lit("")))),
                lambda k: F.struct((-k).alias("k"), c.alias("c")),
            ),
        )
    )
    ratio = threshold / (2 - threshold)
    need = F.length(text) - F.ceil(F.length(text) * ratio - 1e-9) + 1
    return F.slice(F.array_sort(entries), F.lit(1), need.cast("int"))


def _length_bands(length: Column, threshold: float) -> tuple[Column, Column]:
    """Band of a text's length, and the bands that texts similar enough may have.

    A ratio of at least t needs the shorter length to be t/(2-t) of the longer one. With bands of that step similar texts
    lie in one band or in neighbours; for equal texts a band is one length.
    """
    step = (2 - threshold) / threshold
    if step < 1.001:
        return length.cast("int"), F.array(length.cast("int"))
    band = F.floor(F.log(length) / math.log(step) + 1e-9).cast("int")
    return band, F.array(band - 1, band, band + 1)


def agreeing_assets(detections: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Assets where two engines read (nearly) the same target text.

    Equal texts are found by grouping. Unequal texts are compared only when
    they share a prefix token, their lengths lie in neighbouring bands and the places of the
    token leave enough characters to share; each distinct text pair is scored once.
    Needs asset_id, seq, engine, text, confidence, letters.
    """
    key = agreement_text(F.col("text"))
    # stored once: far smaller than the detections and read by every step below
    # (a text with target letters never has an empty key)
    seq = F.when(F.col("letters") > 0, F.col("seq"))
    eligible = cut_lineage(
        detections.filter((F.col("engine") != "") & (F.col("confidence") >= t.agreement_score))
        .groupBy("asset_id", "engine", key.alias("key"))
        .agg(F.min(seq).alias("first_seq"), F.max(seq).alias("last_seq"))
        .filter("first_seq is not null")
    )
    equal = (
        eligible.groupBy("asset_id", "key").agg(F.count("*").alias("engines")).filter("engines > 1")
        .select("asset_id").distinct()
    )
    open_rows = eligible.join(equal, "asset_id", "left_anti")
    band, near_bands = _length_bands(F.length("key"), t.agreement_similarity)
    tokens = open_rows.select(
        "*", band.alias("band"), near_bands.alias("bands"), F.posexplode(_prefix_tokens(F.col("key"), t.agreement_similarity)).alias("place", "token")
    )
    left = tokens.select("asset_id", "token", "band", *[F.col(c).alias(f"l_{c}") for c in ("engine", "key", "first_seq", "place")])
    right = tokens.select("asset_id", "token", F.explode("bands").alias("band"), *[F.col(c).alias(f"r_{c}") for c in ("engine", "key", "last_seq", "place")])
    llen, rlen = F.length("l_key"), F.length("r_key")
    # all characters two texts share stand at or behind the first token they share
    reach = F.least(llen - F.col("l_place"), rlen - F.col("r_place"))
    pairs = cut_lineage(
        left.join(right, ["asset_id", "token", "band"])
        .filter((F.col("l_engine") != F.col("r_engine")) & (F.col("l_key") != F.col("r_key")))
        .filter(F.col("l_first_seq") < F.col("r_last_seq"))
        .filter(2 * reach >= t.agreement_similarity * (llen + rlen) - 1e-9)
        .select("asset_id", "l_key", "r_key")
        .distinct()
    )
    close = (
        pairs.select("l_key", "r_key")
        .distinct()
        .withColumn("ratio", similarity("l_key", "r_key"))
        .filter(F.col("ratio") >= t.agreement_similarity)
        .drop("ratio")
    )
    near = pairs.join(close, ["l_key", "r_key"]).select("asset_id").distinct()
    return equal.unionByName(near)


def asset_evidence(detections: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """One pass over the detections: everything a tier needs but agreement."""
    target = F.col("letters") > 0
    engine = F.nullif(F.col("engine"), F.lit(""))
    blank = is_blank(F.col("text"))
    rank = F.struct("confidence", "letters", "text", (-F.col("seq")).alias("back"))
    # the set of engines is the small fixed list of configured recognizers
    return detections.groupBy("asset_id").agg(
        F.max(F.when(target, rank)).alias("best"),
        F.bool_or(target & (F.col("latin") > 0)).alias("has_latin"),
        F.bool_or(target & (F.col("cyrillic") > 0)).alias("has_cyrillic"),
        F.size(F.collect_set(F.when(target, engine))).alias("target_engines"),
        F.size(F.collect_set(engine)).alias("all_engines"),
        F.bool_or(blank & (F.col("confidence") >= t.review_score)).alias("detector_only"),
        F.max("confidence").alias("top_confidence"),
    )


def classify(detections: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Tier, score, scripts, letter count, engine count and reasons per asset."""
    rows = with_letters(detections)
    evidence = asset_evidence(rows, t).withColumns(
        {"score": F.col("best.confidence"), "letters": F.col("best.letters")}
    )
    strong = (F.col("score") >= t.confirmed_score) & (F.col("letters") >= t.confirmed_letters)
    medium = (F.col("score") >= t.probable_score) & (F.col("letters") >= t.probable_letters)
    agreed = agreeing_assets(rows, t).withColumn("agreed", F.lit(True))
    joined = evidence.join(agreed, "asset_id", "left")
    none = F.col("best").isNull()
    detector = none & F.col("detector_only")
    tier = (
        F.when(detector, "needs_review")
        .when(none, "rejected")
        .when(strong, "confirmed")
        .when(F.col("agreed"), "confirmed")
        .when(medium, "probable")
        .otherwise("needs_review")
    )
    reason = (
        F.when(detector, "detector_only")
        .when(none, "no_latin_or_cyrillic")
        .when(strong, "target_script|primary_high")
        .when(F.col("agreed"), "target_script|engine_agreement")
        .when(medium, "target_script|primary_medium")
        .otherwise("target_script|weak_target_evidence")
    )
    scripts = F.concat_ws("|", F.when(F.col("has_latin"), "latin"), F.when(F.col("has_cyrillic"), "cyrillic"))
    return joined.select(
        "asset_id",
        tier.alias("tier"),
        F.when(detector, F.col("top_confidence")).otherwise(F.coalesce("score", F.lit(0.0))).alias("score"),
        scripts.alias("scripts"),
        F.coalesce("letters", F.lit(0)).alias("target_letter_count"),
        F.when(none, F.col("all_engines")).otherwise(F.col("target_engines")).alias("engine_count"),
        reason.alias("reason_codes"),
    )


def compact_detections(detections: DataFrame, keep: int = 200) -> DataFrame:
    """Strongest reading per (engine, folded text), at most ``keep`` per asset.

    The first step is an aggregation; the second is a limited window, which
    Spark cuts to ``keep`` rows per asset before the shuffle.
    """
    folded = casefold(F.col("text"))
    plain = F.lower(F.col("text"))
    rows = with_letters(detections).withColumns({"folded": folded, "plain": plain})
    has_target = F.when(F.col("letters") > 0, 0).otherwise(1)
    order = F.struct(
        has_target.alias("no_target"),
        (-F.col("confidence")).alias("neg"),
        F.col("engine").alias("e"),
        F.col("folded").alias("f"),
        F.col("variant").alias("v"),
        F.col("seq").alias("s"),
    )
    best = rows.groupBy("asset_id", "engine", "folded").agg(
        F.min(F.struct(order.alias("o"), F.col("text").alias("text"))).alias("b")
    )
    window = Window.partitionBy("asset_id").orderBy("b.o")
    return (
        best.withColumn("position", F.row_number().over(window))
        .filter(F.col("position") <= keep)
        .select(
            "asset_id",
            "position",
            F.col("b.o.s").alias("seq"),
            F.col("b.text").alias("text"),
            "engine",
            (-F.col("b.o.neg")).alias("confidence"),
            F.col("b.o.v").alias("variant"),
        )
    )


def processing_status(calls: DataFrame) -> DataFrame:
    """Status per asset from recognizer calls (asset_id, ok, error, call_no)."""
    # the first error decides the text, so the state stays one row
    first_error = F.min_by("error", F.when(F.col("error").isNotNull(), F.col("call_no")))
    out = calls.groupBy("asset_id").agg(
        count_where(F.col("ok")).alias("variant_calls"),
        F.count("error").alias("errors"),
        first_error.alias("error"),
    )
    status = F.when((F.col("variant_calls") == 0) | (F.col("errors") > 0), "error").otherwise("ok")
    tier = F.when(F.col("variant_calls") == 0, "error")
    return out.withColumns({"status": status, "forced_tier": tier})


# ---- review and reports ---------------------------------------------------


def overlay_reviews(results: DataFrame, reviews: DataFrame) -> DataFrame:
    return (
        results.join(reviews.select("asset_id", "decision", "reviewer"), "asset_id", "left")
        .withColumn("effective_tier", effective_tier(F.col("decision"), F.col("tier")))
    )


def review_queue(results: DataFrame, limit: int | None = None) -> DataFrame:
    """Candidates and errors in (tier, -score, asset_id) order."""
    wanted = results.filter(
        F.col("effective_tier").isin(CANDIDATE_TIERS) | (F.col("status") == "error")
    )
    ordered = wanted.orderBy("effective_tier", F.desc("score"), "asset_id")
    return ordered if limit is None else ordered.limit(limit)


def tier_rank(tier: Column) -> Column:
    rank = F.array_position(_strings(TIER_ORDER), tier)
    return F.when(rank > 0, rank - 1).otherwise(F.lit(9))


def report_rows(results: DataFrame) -> DataFrame:
    """Report order: tier rank, then score, then id."""
    return (
        results.filter(F.col("effective_tier").isin(CANDIDATE_TIERS) | (F.col("status") == "error"))
        .withColumn("rank", tier_rank(F.col("effective_tier")))
        .orderBy("rank", F.desc("score"), "asset_id")
    )


def run_summary(results: DataFrame) -> DataFrame:
    """Long table: totals, tiers and processing counts in one aggregation.

    Needs effective_tier, status, reference_count.
    """
    sets = results.groupBy("effective_tier", "status").agg(
        F.count("*").alias("n"), F.sum("reference_count").alias("refs")
    )
    tiers = sets.groupBy(F.col("effective_tier").alias("name")).agg(F.sum("n").alias("n")).select(
        F.lit("tier").alias("counter"), "name", "n"
    )
    states = sets.groupBy(F.col("status").alias("name")).agg(F.sum("n").alias("n")).select(
        F.lit("processing").alias("counter"), "name", "n"
    )
    totals = sets.agg(
        F.sum("n").alias("unique_textures"),
        F.sum("refs").alias("source_references"),
        F.sum(F.when(F.col("effective_tier").isin(CANDIDATE_TIERS), F.col("n")).otherwise(0)).alias(
            "candidate_textures"
        ),
    ).unpivot([], ["unique_textures", "source_references", "candidate_textures"], "name", "n").select(
        F.lit("total").alias("counter"), "name", "n"
    )
    return totals.unionByName(tiers).unionByName(states)


def catalog_destinations(references: DataFrame) -> DataFrame:
    """Catalog folders of each asset from (asset_id, asset_type, group).

    Known types give one row each; an asset without a known type goes to the
    unknown root. Only counts and minima are kept per asset.
    """
    named = F.when(~is_blank(F.col("group")), F.col("group"))
    known = F.col("asset_type").isin("map", "item")
    per_type = references.withColumn("named", named).groupBy("asset_id", "asset_type").agg(
        F.min("named").alias("lo"), F.max("named").alias("hi")
    )
    one = F.col("lo") == F.col("hi")
    flagged = per_type.groupBy("asset_id").agg(
        F.max(F.when(known, F.struct(F.lit(1).alias("one")))).isNotNull().alias("has_known"),
        F.min("lo").alias("all_lo"),
        F.max("hi").alias("all_hi"),
    )
    routed = per_type.filter(known).select(
        "asset_id",
        F.when(F.col("asset_type") == "map", "maps").otherwise("items").alias("root"),
        F.when(one, F.col("lo"))
        .when(F.col("lo").isNotNull(), "_shared")
        .when(F.col("asset_type") == "map", "_unassigned")
        .otherwise("_uncategorized")
        .alias("folder"),
    )
    unknown = flagged.filter(~F.col("has_known")).select(
        "asset_id",
        F.lit("unknown").alias("root"),
        F.when(F.col("all_lo") == F.col("all_hi"), F.col("all_lo")).otherwise("_unassigned").alias("folder"),
    )
    return routed.unionByName(unknown)


def verified_source(references: DataFrame, current: DataFrame) -> DataFrame:
    """First reference by path whose file still has the recorded hash."""
    live = current.select("path", F.col("sha256").alias("live_sha256"))
    ok = references.join(live, "path").filter(F.col("sha256") == F.col("live_sha256"))
    return ok.groupBy("asset_id").agg(
        F.min_by(F.struct("path", "sha256"), F.struct(F.lower("path"), F.col("path"))).alias("s")
    ).select("asset_id", "s.path", "s.sha256")


def materialize_actions(plan: DataFrame, existing: DataFrame, overwrite: bool = False) -> DataFrame:
    """Copy, repair, keep or skip per destination file.

    ``plan``: target, asset_id, sha256; ``existing``: target, file_sha256 (null
    when only the sidecar exists), sidecar_asset_id (null without a sidecar).
    """
    joined = plan.join(existing, "target", "left")
    file, side = F.col("file_sha256"), F.col("sidecar_asset_id")
    action = (
        F.when(file.isNull() & side.isNull(), "copy")
        .when(F.lit(overwrite), "copy")
        .when(file.isNotNull() & side.isNotNull(), "keep")
        .when(file.isNotNull(), F.when(file == F.col("sha256"), "repair").otherwise("skip"))
        .otherwise(F.when(side == F.col("asset_id"), "repair").otherwise("skip"))
    )
    return joined.withColumn("action", action)


# ---- names and caches -----------------------------------------------------


def refresh_index(old: DataFrame, scanned: DataFrame, rescanned: DataFrame) -> DataFrame:
    """Texture index as (name, bundle_key) rows after re-scanning some bundles."""
    kept = old.join(rescanned.select("bundle_key").distinct(), "bundle_key", "left_anti")
    return kept.select("name", "bundle_key").unionByName(scanned.select("name", "bundle_key")).distinct()


def lookup_names(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """Case-blind lookup; the first position of each bundle key is kept."""
    left = wanted.select(F.lower("name").alias("low")).distinct()
    return (
        index.withColumn("low", F.lower("name"))
        .join(left, "low", "left_semi")
        .groupBy("low", "bundle_key")
        .agg(F.min("position").alias("position"))
    )


def search_names(index: DataFrame, query: str) -> DataFrame:
    return index.filter(F.contains(F.lower("name"), F.lit(query.lower()))).orderBy("name", "bundle_key")


def cache_status(results: DataFrame, reviews: DataFrame, runs: DataFrame) -> DataFrame:
    """One row: stored results, assets with a visible review, review rows, the newest run and its summary.

    ``reviews`` is the log of decisions, ``runs`` has run_id, finished_at and summary; a run that never finished is passed over.
    """
    shown = current_reviews(reviews).agg(F.count("*").alias("reviewed_assets"))
    logged = reviews.agg(F.count("*").alias("review_rows"), F.max("reviewed_at").alias("latest_review"))
    stored = results.agg(F.count("*").alias("cached_results"))
    done = runs.filter("finished_at is not null").agg(
        F.max_by(F.struct("run_id", "summary"), F.struct("finished_at", "run_id")).alias("_run"), F.max("finished_at").alias("latest_run_at")
    )
    rows = [part.withColumn("_one", F.lit(1)) for part in (stored, shown, logged, done)]  # one row each
    joined = rows[0].join(rows[1], "_one").join(rows[2], "_one").join(rows[3], "_one")
    return joined.select(
        "cached_results", "reviewed_assets", "review_rows", "latest_review", F.col("_run.run_id").alias("latest_run"), F.col("_run.summary").alias("latest_summary"), "latest_run_at"
    )


def prefer_edited(wanted: DataFrame, edited: DataFrame, raw: DataFrame) -> DataFrame:
    """Source of each wanted name: the edited file if there is one, else the raw one; names with neither are left out.

    ``wanted``: name and any other columns; ``edited`` and ``raw``: name, file (one row a name).
    """
    both = wanted.join(edited.select("name", F.col("file").alias("_edited")), "name", "left").join(
        raw.select("name", F.col("file").alias("_raw")), "name", "left"
    )
    return both.withColumn("source", F.coalesce("_edited", "_raw")).drop("_edited", "_raw").filter("source is not null")


def reusable_by_fingerprint(work: DataFrame, cache: DataFrame, fields: list[str]) -> DataFrame:
    """Work rows with the fingerprint of ``fields`` and whether the cache (fingerprint) holds it.

    Fields are hashed with their lengths, nulls told apart, so no two settings share a fingerprint.
    """
    marked = work.withColumn("fingerprint", sha256_hex(field_text(*[F.col(c) for c in fields])))
    held = cache.select("fingerprint").distinct().withColumn("_held", F.lit(True))
    return marked.join(held, "fingerprint", "left").withColumn("reused", F.coalesce("_held", F.lit(False))).drop("_held")


def cache_state(work: DataFrame, cache: DataFrame, force: bool = False) -> DataFrame:
    """``hit`` rows reuse the stored result; corrupt JSON counts as a miss."""
    parsed = F.try_parse_json("result_json")
    valid = cache.filter(parsed.isNotNull() & (F.schema_of_variant(parsed).startswith("OBJECT")))
    stored = valid.select("cache_key", F.col("result_json").alias("cached_json"))
    joined = work.join(stored, "cache_key", "left")
    hit = F.col("cached_json").isNotNull() & F.lit(not force)
    return joined.withColumn("state", F.when(hit, "hit").otherwise("miss"))


def latest_by(log: DataFrame, keys: list[str], at: str, values: list[str]) -> DataFrame:
    """Last value per key by time: an aggregation, so it combines map-side."""
    last = F.max_by(F.struct(*values), F.struct(at, *values))
    return log.groupBy(*keys).agg(last.alias("_v"), F.max(at).alias(at)).select(*keys, "_v.*", at)


def current_reviews(log: DataFrame) -> DataFrame:
    """Latest decision per asset; ``clear`` removes it."""
    allowed = log.filter(F.col("decision").isin([*REVIEWABLE, "clear"]))
    return latest_by(allowed, ["asset_id"], "reviewed_at", ["decision", "reviewer"]).filter(
        "decision <> 'clear'"
    )
