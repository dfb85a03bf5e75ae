"""Evidence gates: contracts, plan diffs, readiness, approvals, releases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arithmetic import count_where, issue_codes
from ..functions.boxes import valid_box
from ..functions.ids import sha256_hex, tree_digest

PLAN_KEY = ["texture_bundle_key", "path_id", "role"]
# Fixed value: generation attempts allowed per panel.
ATTEMPT_LIMIT = 2


# ---- contracts ------------------------------------------------------------


def box_violations(regions: DataFrame, width: int, height: int) -> DataFrame:
    box = {c: F.col(c) for c in ("x0", "y0", "x1", "y1")}
    return regions.filter(~valid_box(box, F.lit(width), F.lit(height)))


def contract_issues(contracts: DataFrame, inventory: DataFrame) -> DataFrame:
    """Issue codes of each auxiliary-map contract against the inventory.

    ``contracts``: PLAN_KEY, width, height, format, scale_u, offset_u,
    source_sha256, whole_map_generated, channels, signature_ok, sample_count,
    measured, recorded; ``inventory``: PLAN_KEY and the same identity columns.
    """
    identity = ["width", "height", "format", "scale_u", "offset_u", "source_sha256"]
    known = inventory.select(*PLAN_KEY, *[F.col(c).alias(f"i_{c}") for c in identity], F.lit(True).alias("_found"))
    joined = contracts.join(known, PLAN_KEY, "left")

    def differs(c: str) -> Column:
        return ~F.col(c).eqNullSafe(F.col(f"i_{c}"))

    normal, gloss = F.col("role") == "normal", F.col("role") == "gloss"
    # Channels allowed by role and texture format.
    bad_channels = (
        (normal & ((F.col("format") != 12) | (F.col("channels") != "GA")))
        | (gloss & ~F.col("format").isin(10, 12))
        | (gloss & (F.col("format") == 10) & F.contains("channels", F.lit("A")))
    )
    found = F.col("_found")
    issues = issue_codes(
        unknown_map=found.isNull(),
        identity_differs=found & (differs("width") | differs("height") | differs("format")),
        transform_differs=found & (differs("scale_u") | differs("offset_u")),
        source_hash_differs=found & differs("source_sha256"),
        whole_map_generated=~F.col("whole_map_generated").eqNullSafe(F.lit(False)),
        channels_not_allowed=bad_channels,
        signature_unknown=~F.col("signature_ok"),
        no_samples=F.coalesce("sample_count", F.lit(0)) < 1,
        measurement_differs=~F.col("measured").eqNullSafe(F.col("recorded")),
    )
    return joined.select(*PLAN_KEY, F.array_join(issues, "|").alias("issues"))


def plan_diff(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Differences between expected and recorded shared-map plans.

    Both: PLAN_KEY, policy, mask_sha256, signature, target_id (one row per
    target). Target sets are compared by digest.
    """

    def folded(df: DataFrame, p: str) -> DataFrame:
        # a target set is a set: repeats are removed before it is digested
        once = df.groupBy(*PLAN_KEY, "target_id").agg(
            F.count("*").alias("n"), F.min("policy").alias("policy"), F.min("mask_sha256").alias("mask_sha256"), F.min("signature").alias("signature")
        )
        facts = once.groupBy(*PLAN_KEY).agg(
            F.min("policy").alias(f"{p}_policy"), F.min("mask_sha256").alias(f"{p}_mask"), F.min("signature").alias(f"{p}_signature"),
            F.max("n").alias(f"{p}_repeats"),
        )
        return facts.join(tree_digest(once, PLAN_KEY, sha256_hex(F.col("target_id")), f"{p}_targets").drop("n"), PLAN_KEY)

    joined = folded(expected, "e").join(folded(actual, "a"), PLAN_KEY, "full")
    e, a = F.col("e_targets").isNotNull(), F.col("a_targets").isNotNull()
    both = e & a

    def differs(c: str) -> Column:
        return both & ~F.col(f"e_{c}").eqNullSafe(F.col(f"a_{c}"))

    issues = issue_codes(
        missing=e & ~a, extra=a & ~e, policy_differs=differs("policy"), mask_differs=differs("mask"),
        signature_differs=differs("signature"), targets_differ=differs("targets"), repeated_target=both & (F.col("a_repeats") > 1),
    )
    return joined.select(*PLAN_KEY, F.array_join(issues, "|").alias("issues")).filter("issues <> ''")


def output_cardinality(plans: DataFrame, outputs: DataFrame, known_targets: DataFrame, wanted: DataFrame) -> DataFrame:
    """Plan/output cardinality, membership and selection.

    ``plans``: PLAN_KEY, policy, target_id rows; ``outputs``: PLAN_KEY, target_id.
    """
    members = plans.select(*PLAN_KEY, "target_id").distinct()
    known = known_targets.select("target_id", F.lit(True).alias("_known")).distinct()
    chosen = wanted.select("target_id", F.lit(True).alias("_wanted")).distinct()
    per_plan = (
        plans.join(known, "target_id", "left").join(chosen, "target_id", "left")
        .groupBy(*PLAN_KEY)
        .agg(
            F.min("policy").alias("policy"), count_where(F.col("_known").isNull()).alias("unknown_targets"),
            (count_where(F.col("_wanted")) > 0).alias("touches_selection"),
        )
    )
    marked = outputs.join(members.withColumn("_member", F.lit(True)), [*PLAN_KEY, "target_id"], "left")
    counted = marked.groupBy(*PLAN_KEY).agg(
        F.count("*").alias("outputs"), count_where(F.col("_member").isNull()).alias("foreign_outputs")
    )
    joined = per_plan.join(counted, PLAN_KEY, "full").fillna(0, ["outputs", "foreign_outputs"])
    preserve = F.col("policy") == "preserve"
    issues = issue_codes(
        output_without_plan=F.col("policy").isNull(),
        preserve_has_output=preserve & (F.col("outputs") > 0),
        not_exactly_one_output=~preserve & (F.col("outputs") != 1),
        output_target_not_in_plan=F.col("policy").isNotNull() & (F.col("foreign_outputs") > 0),
        unknown_target=F.col("unknown_targets") > 0,
    )
    selected = F.coalesce(F.col("touches_selection") & ~preserve & (F.col("outputs") == 1), F.lit(False))
    return joined.select(*PLAN_KEY, F.array_join(issues, "|").alias("issues"), selected.alias("selected"))


def stale_outputs(plans: DataFrame, closure: DataFrame, selected: DataFrame, current: DataFrame, reports: DataFrame) -> DataFrame:
    """Preserved maps whose old output may go.

    All consumer targets must be selected, the bundle not be rebuilt now, and
    the report must still own the output. ``closure``: texture_bundle_key,
    path_id, target_id; ``reports``: bundle_key, output_ok.
    """
    chosen = selected.select("target_id", F.lit(True).alias("_sel")).distinct()
    covered = closure.join(chosen, "target_id", "left").groupBy("texture_bundle_key", "path_id").agg(
        F.bool_and(F.col("_sel").isNotNull()).alias("all_selected")
    )
    owned = reports.filter("output_ok").select(F.col("bundle_key").alias("texture_bundle_key")).distinct()
    return (
        plans.filter("policy = 'preserve'").select("texture_bundle_key", "path_id", "role").distinct()
        .join(covered.filter("all_selected"), ["texture_bundle_key", "path_id"], "left_semi")
        .join(current.select(F.col("bundle_key").alias("texture_bundle_key")).distinct(), "texture_bundle_key", "left_anti")
        .join(owned, "texture_bundle_key", "left_semi")
    )


def compare_evidence(recorded: DataFrame, current: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One issue row per key and field that is not the same on both sides."""
    r = recorded.select(key, *[F.col(c).alias(f"r_{c}") for c in fields], F.lit(True).alias("_r"))
    c = current.select(key, *[F.col(c).alias(f"c_{c}") for c in fields], F.lit(True).alias("_c"))
    joined = r.join(c, key, "full")
    both = F.col("_r") & F.col("_c")
    codes = [F.when(F.col("_r").isNull(), "not_recorded"), F.when(F.col("_c").isNull(), "not_current")]
    codes += [F.when(both & ~F.col(f"r_{f}").eqNullSafe(F.col(f"c_{f}")), f) for f in fields]
    return joined.select(key, F.explode(F.array_compact(F.array(*codes))).alias("issue"))


def panel_transform_issues(panels: DataFrame) -> DataFrame:
    """Consistency of a panel's recorded transform with its region."""

    def close(a: str, b: Column) -> Column:
        return F.abs(F.col(a) - b) <= 1e-6

    inside = (
        (F.col("crop_x0") <= F.col("x0")) & (F.col("crop_y0") <= F.col("y0")) & (F.col("crop_x1") >= F.col("x1")) & (F.col("crop_y1") >= F.col("y1"))
    )
    issues = issue_codes(
        crop_misses_region=~inside,
        negative_padding=F.col("padding") < 0,
        source_rotation=~close("source_rotation", F.col("rotation_deg")),
        deskew_rotation=~close("deskew_rotation", F.col("rotation_deg")),
        inverse_rotation=~close("inverse_rotation", -F.col("rotation_deg")),
    )
    return panels.select("panel_id", F.array_join(issues, "|").alias("issues"))


def panel_ocr_binding(panels: DataFrame, regions: DataFrame, results: DataFrame) -> DataFrame:
    """Panels whose image hash and every region reading are bound literally.

    ``panels``: panel_id, image_sha256, panel_sha256; ``regions``: panel_id,
    region_id, text; ``results``: panel_id, region_id, expected_text, matched, match_mode.
    """
    r = results.withColumn("_found", F.lit(True))
    joined = regions.join(r, ["panel_id", "region_id"], "left")
    good = F.col("_found") & (F.col("text") == F.col("expected_text")) & F.col("matched") & (F.col("match_mode") == "nfc-literal")
    per = joined.groupBy("panel_id").agg(
        F.count("*").alias("regions"), count_where(F.coalesce(good, F.lit(False))).alias("bound_regions")
    )
    same = F.col("image_sha256") == F.col("panel_sha256")
    return panels.join(per, "panel_id").select(
        "panel_id", "regions", "bound_regions", (same & (F.col("regions") == F.col("bound_regions"))).alias("bound")
    )


# ---- readiness and attempts -----------------------------------------------


def latest_stages(log: DataFrame) -> DataFrame:
    return log.groupBy("target_id", "stage").agg(
        F.max_by(F.struct("status", "evidence_sha256"), F.struct("ts", "evidence_sha256")).alias("s")
    ).select("target_id", "stage", "s.*")


def stage_crosstab(stages: DataFrame, states: list[str]) -> DataFrame:
    return stages.groupBy("stage").pivot("status", states).count().fillna(0)


def approval_progress(targets: DataFrame, approved: DataFrame) -> DataFrame:
    """State of each target: preserve, approved or pending."""
    done = approved.select("target_id", F.lit(True).alias("_a")).distinct()
    state = F.when(F.col("action") == "preserve", "preserve").when(F.col("_a"), "approved").otherwise("pending")
    return targets.join(done, "target_id", "left").select("target_id", state.alias("state"))


def approval_rollup(targets: DataFrame, reports: DataFrame) -> DataFrame:
    """Totals of an approval run: preserved targets pass, missing ones block."""
    joined = targets.join(reports.select("target_id", "passed"), "target_id", "left")
    preserve = F.col("action") == "preserve"
    missing = ~preserve & F.col("passed").isNull()
    return joined.agg(
        F.count("*").alias("target_count"), count_where(preserve).alias("preserved_count"),
        count_where(~preserve & F.col("passed").isNotNull()).alias("approved_count"), count_where(missing).alias("missing_count"),
        F.bool_and(preserve | F.coalesce("passed", F.lit(False))).alias("passed"),
    )


def panel_attempts(regions: DataFrame, attempts: DataFrame) -> DataFrame:
    """Highest recorded attempts per (target, face, rotation), in stable order.

    ``regions``: target_id, region_id, face, rotation_deg; ``attempts``:
    region_id, attempts. The panel id carries its order and a digest.
    """
    best = attempts.groupBy("region_id").agg(F.max("attempts").alias("attempts"))
    keys = ["target_id", "face", "rotation_deg"]
    per = regions.join(best, "region_id", "left").groupBy(*keys).agg(
        F.coalesce(F.max("attempts"), F.lit(0)).alias("attempts"), F.min("region_id").alias("first_region")
    )
    # panels of one target: faces times rotations, a handful
    order = Window.partitionBy("target_id").orderBy("first_region")
    seed = F.concat(F.col("face"), F.lit("\0"), F.col("rotation_deg").cast("double").cast("string"))
    number = F.row_number().over(order)
    return per.withColumn("n", number).select(
        *keys, "attempts", F.concat(F.format_string("panel-%02d-", "n"), F.substring(sha256_hex(seed), 1, 8)).alias("panel_id")
    )


def local_attempts(panels: DataFrame, jobs: DataFrame) -> DataFrame:
    """Generated jobs matched by panel id, or by face and rotation.

    The OR is split in two equi-joins; jobs matching both ways count once.
    Attempts are the larger of the job count and the highest recorded attempt.
    """
    keys = ["target_id", "panel_id"]
    done = jobs.filter("generated").select(
        "job_id", "target_id", F.col("panel_id").alias("job_panel"), "face", "rotation_deg", F.col("attempt")
    )
    base = panels.select(*keys, "face", "rotation_deg")
    by_id = base.select(*keys).join(
        done.select("job_id", "target_id", F.col("job_panel").alias("panel_id"), "attempt"), keys
    )
    by_side = base.join(done.select("job_id", "target_id", "face", "rotation_deg", "attempt"), ["target_id", "face", "rotation_deg"])
    hits = by_id.select(*keys, "job_id", "attempt").unionByName(by_side.select(*keys, "job_id", "attempt")).distinct()
    counted = hits.groupBy(*keys).agg(F.greatest(F.count("*"), F.coalesce(F.max("attempt"), F.lit(0))).alias("local"))
    return panels.join(counted, keys, "left").withColumn(
        "current_attempts", F.greatest(F.col("attempts"), F.coalesce("local", F.lit(0)))
    ).select(*keys, "attempts", "current_attempts")


def attempt_budget(current: DataFrame, legacy: DataFrame) -> DataFrame:
    """Recorded attempts and exhaustion per target.

    ``current``: target_id, current_attempts per panel; ``legacy``: target_id,
    legacy_attempts. Exhausted when legacy reaches the limit, or every panel does.
    """
    per = current.groupBy("target_id").agg(
        F.max("current_attempts").alias("top"), F.bool_and(F.col("current_attempts") >= ATTEMPT_LIMIT).alias("all_panels")
    )
    joined = legacy.join(per, "target_id", "full")
    old = F.coalesce("legacy_attempts", F.lit(0))
    return joined.select(
        "target_id", F.greatest(old, F.coalesce("top", F.lit(0))).alias("recorded_attempts"),
        ((old >= ATTEMPT_LIMIT) | F.coalesce("all_panels", F.lit(False))).alias("exhausted"),
    )


# The status names below.
def readiness(targets: DataFrame) -> DataFrame:
    """Status and issue codes of each target.

    ``targets``: target_id, action, record_error, analysis_error, mask_error, exhausted.
    """
    a, m, x = F.col("analysis_error"), F.col("mask_error"), F.col("exhausted")
    preserve, broken = F.col("action") == "preserve", F.col("record_error")
    status = (
        F.when(preserve, "preserve")
        .when(broken, "record-or-source-error")
        .when(a & m, "analysis-and-masks-required")
        .when(a, "analysis-required")
        .when(m, "masks-required")
        .when(x, "attempt-budget-exhausted")
        .otherwise("ready")
    )
    live = ~preserve & ~broken
    codes = F.array_compact(F.array(
        F.when(~preserve & broken, "record-or-source-error"), F.when(live & a, "analysis-required"),
        F.when(live & m, "masks-required"), F.when(~preserve & x, "attempt-budget-exhausted"),
    ))
    return targets.select("target_id", status.alias("status"), F.array_join(codes, "|").alias("issue_codes"))


# Work requested by readiness status.
REQUESTED_WORK = {
    "record-or-source-error": "source-and-review-audit",
    "analysis-required": "analysis",
    "masks-required": "masks",
    "analysis-and-masks-required": "analysis|masks",
    "attempt-budget-exhausted": "attempt-budget-approval",
}


def preparation_request(ready: DataFrame, pins: DataFrame) -> DataFrame:
    """Work list of the targets that are not ready.

    ``pins``: target_id, path, state (ok/changed/missing); any state but ok is
    drift. The request digest covers status and pins of each target.
    """
    pin = sha256_hex(F.concat_ws("|", "path", "sha256"))
    per = tree_digest(pins, ["target_id"], pin, "pins_digest", drifted_pins=F.col("state") != "ok")
    work = F.lit(None).cast("string")
    for status, name in REQUESTED_WORK.items():
        work = F.when(F.col("status") == status, F.lit(name)).otherwise(work)
    todo = ready.filter(~F.col("status").isin("preserve", "ready"))
    return todo.join(per, "target_id", "left").select(
        "target_id", "status", work.alias("requested_work"), F.coalesce("drifted_pins", F.lit(0)).alias("drifted_pins"),
        sha256_hex(F.concat_ws("|", "target_id", "status", F.coalesce("pins_digest", F.lit("")))).alias("request_digest"),
    )


# ---- releases and roll-ups ------------------------------------------------


def release_id(tables: dict[str, DataFrame], constants: dict[str, str]) -> DataFrame:
    """16 hex digits over the digests of several (name, sha256) tables."""
    parts = None
    for name in sorted(tables):
        row = tree_digest(tables[name], [], sha256_hex(F.concat_ws("|", "name", "sha256"))).select(F.lit(name).alias("part"), "digest")
        parts = row if parts is None else parts.unionByName(row)
    # one row per table: a few rows
    joined = F.concat_ws(";", F.transform(F.array_sort(F.collect_list(F.struct("part", "digest"))), lambda p: F.concat(p["part"], F.lit("="), p["digest"])))
    fixed = ";".join(f"{k}={constants[k]}" for k in sorted(constants))
    return parts.agg(F.substring(sha256_hex(F.concat(joined, F.lit("#" + fixed))), 1, 16).alias("release_id"))


def run_rollup(rows: DataFrame, group: str) -> DataFrame:
    """Counts and all-pass flag per group; partial runs are marked."""
    return rows.groupBy(group).agg(
        F.count("*").alias("items"), count_where(F.col("passed")).alias("passed_items"), F.bool_and("passed").alias("passed"),
        F.bool_or("partial").alias("partial"), F.min("item_id").alias("first_id"), F.max("item_id").alias("last_id"),
    )


def replacements(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One image per (bundle, texture) with roles and coverages; and duplicates."""
    keys = ["bundle_key", "texture"]
    per = rows.groupBy(*keys).agg(
        F.min("image").alias("image"), F.count_distinct("image").alias("images"), F.min("role").alias("role"), F.count_distinct("target_id").alias("coverages")
    )
    return per.filter("images = 1").drop("images"), per.filter("images > 1").select(*keys, "images")


def candidate_verdict(gates: DataFrame) -> DataFrame:
    """Conjunction of the measured conditions of a candidate."""
    ok = (
        (F.col("changed_alpha") == 0) & (F.col("changed_pixels") > 0) & (F.col("changed_outside_editable") == 0)
        & (F.col("changed_inside_protected") == 0) & (F.col("changed_inside_seam_guard") == 0) & (F.col("padding_mismatch_pixels") == 0)
        & (F.col("foreign_detections") == 0) & F.col("expected_text_matched") & ~F.col("duplicate_text")
    )
    return gates.select("texture_id", ok.alias("passed"))
