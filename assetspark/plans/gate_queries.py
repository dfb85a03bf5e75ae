"""Gate queries: contracts, diffs, readiness, approvals, releases."""

from pyspark.sql import functions as F

from ..functions.ids import tree_digest_sql
from ..operators import gates, graph, texels
from .graph_queries import _AUX, _CLOSE, _MT, _PLANS, _ROLE, _aux_plans, _aux_textures
from .registry import Registry
from .texel_queries import _NEED, _PAIRS, _pairs

GATES = Registry()


@GATES.query(
    "p19_box_validity",
    "SELECT region_id FROM regions WHERE NOT (x0>=0 AND y0>=0 AND x1>x0 AND y1>y0 AND x1<=350 AND y1<=360)",
    "regions",
)
def box_validity(t):
    return gates.box_violations(t.regions, 350, 360).select("region_id")


_CONTRACT = """c AS (SELECT 'tex/'||(p_partkey%20) AS texture_bundle_key, p_partkey AS path_id, CASE WHEN p_partkey%2=0 THEN 'normal' ELSE 'gloss' END AS role, p_partkey%7 AS k7, p_partkey%11 AS k11, p_partkey%13 AS k13, p_size FROM part)"""


@GATES.query(
    "p23_contract_issues",
    f"""WITH {_CONTRACT} SELECT texture_bundle_key, path_id, role, concat_ws('|',
      CASE WHEN (role='normal' AND (CASE WHEN k7=1 THEN 10 ELSE 12 END<>12 OR CASE WHEN k11=1 THEN 'RGA' ELSE 'GA' END<>'GA')) OR (role='gloss' AND k7=1) THEN 'channels_not_allowed' END,
      CASE WHEN path_id%17<>0 AND k7=2 THEN 'identity_differs' END, CASE WHEN k13=3 THEN 'measurement_differs' END, CASE WHEN p_size=7 THEN 'no_samples' END,
      CASE WHEN k11=4 THEN 'signature_unknown' END, CASE WHEN path_id%17<>0 AND k13=5 THEN 'source_hash_differs' END, CASE WHEN path_id%17<>0 AND k11=5 THEN 'transform_differs' END,
      CASE WHEN path_id%17=0 THEN 'unknown_map' END, CASE WHEN k13=7 THEN 'whole_map_generated' END) AS issues FROM c""",
)
def contract_issues(t):
    p = F.col("p_partkey")
    key = [F.concat(F.lit("tex/"), p % 20).alias("texture_bundle_key"), p.alias("path_id"), F.when(p % 2 == 0, "normal").otherwise("gloss").alias("role")]
    fmt = F.when(p % 7 == 1, 10).otherwise(12)
    same = [F.lit(64).alias("height"), fmt.alias("format"), F.lit(1.0).alias("scale_u"), F.sha2("p_name", 256).alias("source_sha256")]
    contracts = t.part.select(
        *key, *same, F.when(p % 7 == 2, 32).otherwise(64).alias("width"), F.when(p % 11 == 5, 0.5).otherwise(0.0).alias("offset_u"),
        F.when(p % 13 == 7, F.lit(None).cast("boolean")).otherwise(False).alias("whole_map_generated"),
        F.when(p % 11 == 1, "RGA").otherwise("GA").alias("channels"), (p % 11 != 4).alias("signature_ok"),
        F.when(F.col("p_size") == 7, 0).otherwise(5).alias("sample_count"), (p % 5).alias("measured"),
        F.when(p % 13 == 3, p % 5 + 1).otherwise(p % 5).alias("recorded"),
    ).withColumn("source_sha256", F.when(F.col("path_id") % 13 == 5, "x").otherwise(F.col("source_sha256")))
    inventory = t.part.filter(p % 17 != 0).select(*key, *same, F.lit(64).alias("width"), F.lit(0.0).alias("offset_u"))
    return gates.contract_issues(contracts, inventory)


_PD = f"""{_MT}, {_PLANS}, ex AS (SELECT texture_bundle_key, path_id, role, target_id, path_id%4 AS policy FROM pl WHERE path_id%10<>3),
    ac AS (SELECT texture_bundle_key, path_id, role, target_id, CASE WHEN path_id%12=1 THEN 9 ELSE path_id%4 END AS policy FROM pl WHERE path_id%10<>4 AND NOT (path_id%9=2 AND length(target_id)%2=0)),
    fe AS (SELECT texture_bundle_key, path_id, role, min(policy) AS p, string_agg(DISTINCT target_id, ',' ORDER BY target_id) AS ts FROM ex GROUP BY 1,2,3),
    fa AS (SELECT texture_bundle_key, path_id, role, min(policy) AS p, string_agg(DISTINCT target_id, ',' ORDER BY target_id) AS ts FROM ac GROUP BY 1,2,3),
    j AS (SELECT texture_bundle_key, path_id, role, fe.p AS ep, fa.p AS ap, fe.ts AS et, fa.ts AS ats FROM fe FULL JOIN fa USING (texture_bundle_key, path_id, role)),
    o AS (SELECT texture_bundle_key, path_id, role, concat_ws('|', CASE WHEN et IS NULL THEN 'extra' END, CASE WHEN ats IS NULL THEN 'missing' END,
      CASE WHEN et IS NOT NULL AND ats IS NOT NULL AND ep<>ap THEN 'policy_differs' END, CASE WHEN et<>ats THEN 'targets_differ' END) AS issues FROM j)"""


@GATES.query("j19_plan_diff", f"WITH {_PD} SELECT * FROM o WHERE issues<>''", "slots targets")
def plan_diff(t):
    plans = _aux_plans(t).drop("signature").withColumns({"mask_sha256": F.lit("m"), "signature": F.lit("s")})
    i = F.col("path_id")
    expected = plans.filter(i % 10 != 3).withColumn("policy", (i % 4).cast("string"))
    actual = plans.filter((i % 10 != 4) & ~((i % 9 == 2) & (F.length("target_id") % 2 == 0))).withColumn(
        "policy", F.when(i % 12 == 1, "9").otherwise((i % 4).cast("string"))
    )
    return gates.plan_diff(expected, actual)


_PO = f"""{_MT}, {_PLANS}, pp AS (SELECT texture_bundle_key, path_id, role, target_id, CASE WHEN path_id%4=0 THEN 'preserve' ELSE 'derive' END AS policy FROM pl),
    ou AS (SELECT texture_bundle_key, path_id, role, min(target_id) AS target_id FROM pl WHERE path_id%9<>0 GROUP BY 1,2,3
      UNION ALL SELECT texture_bundle_key, path_id, role, 'zz' FROM pl WHERE path_id%10=1 GROUP BY 1,2,3),
    pe AS (SELECT texture_bundle_key, path_id, role, min(policy) AS policy, count(*) FILTER (target_id LIKE 't9%') AS unk, bool_or(target_id LIKE 't2%') AS tch FROM pp GROUP BY 1,2,3),
    oc AS (SELECT texture_bundle_key, path_id, role, count(*) AS n, count(*) FILTER (target_id='zz') AS fo FROM ou GROUP BY 1,2,3)
    SELECT texture_bundle_key, path_id, role, concat_ws('|', CASE WHEN policy<>'preserve' AND coalesce(n,0)<>1 THEN 'not_exactly_one_output' END,
      CASE WHEN coalesce(fo,0)>0 THEN 'output_target_not_in_plan' END, CASE WHEN policy='preserve' AND coalesce(n,0)>0 THEN 'preserve_has_output' END,
      CASE WHEN unk>0 THEN 'unknown_target' END) AS issues, tch AND policy<>'preserve' AND coalesce(n,0)=1 AS selected FROM pe LEFT JOIN oc USING (texture_bundle_key, path_id, role)"""


@GATES.query("j38_output_cardinality", f"WITH {_PO}", "slots targets")
def output_cardinality(t):
    i = F.col("path_id")
    plans = _aux_plans(t).drop("signature").withColumn("policy", F.when(i % 4 == 0, "preserve").otherwise("derive"))
    key = gates.PLAN_KEY
    outputs = plans.filter(i % 9 != 0).groupBy(*key).agg(F.min("target_id").alias("target_id")).unionByName(
        plans.filter(i % 10 == 1).select(*key).distinct().withColumn("target_id", F.lit("zz"))
    )
    known = t.targets.filter("target_id not like 't9%'")
    wanted = t.targets.filter("target_id like 't2%'")
    return gates.output_cardinality(plans, outputs, known, wanted)


@GATES.query(
    "j27_stale_outputs",
    f"""WITH {_MT}, {_CLOSE}, ax AS (SELECT DISTINCT texture_bundle_key, path_id, {_ROLE} AS role FROM slots WHERE property IN {_AUX}),
    cv AS (SELECT texture_bundle_key, path_id FROM fin GROUP BY 1,2 HAVING bool_and(target_id='__unmapped_consumer__' OR length(target_id)%2=0))
    SELECT texture_bundle_key, path_id, role FROM ax JOIN cv USING (texture_bundle_key, path_id)
    WHERE path_id%2=0 AND texture_bundle_key NOT IN ('tex/3','tex/4') AND texture_bundle_key NOT IN ('tex/7')""",
    "slots targets",
)
def stale_outputs(t):
    aux = t.slots.withColumn("role", graph.auxiliary_role(F.col("property"))).filter("role is not null")
    plans = aux.select("texture_bundle_key", "path_id", "role", F.when(F.col("path_id") % 2 == 0, "preserve").otherwise("derive").alias("policy"))
    closure = graph.consumer_closure(t.slots, t.targets, _aux_textures(t))
    # the marker counts as selected here so that the small tables keep some rows
    selected = closure.filter((F.col("target_id") == graph.UNMAPPED) | (F.length("target_id") % 2 == 0)).select("target_id").distinct()
    bundles = t.slots.select(F.col("texture_bundle_key").alias("bundle_key")).distinct()
    current = bundles.filter("bundle_key in ('tex/3', 'tex/4')")
    reports = bundles.withColumn("output_ok", F.col("bundle_key") != "tex/7")
    return gates.stale_outputs(plans, closure, selected, current, reports)


@GATES.query(
    "j29_binding_equality",
    f"""WITH {_MT}, r AS (SELECT target_id, string_agg(bundle_key||':'||material_path_id, ',' ORDER BY material_path_id) AS s FROM mt WHERE material_path_id%50<>0 GROUP BY 1),
    c AS (SELECT target_id, string_agg(bundle_key||':'||material_path_id, ',' ORDER BY material_path_id) AS s FROM mt WHERE material_path_id%70<>0 GROUP BY 1)
    SELECT target_id, CASE WHEN r.s IS NULL THEN 'not_recorded' WHEN c.s IS NULL THEN 'not_current' ELSE 'digest' END AS issue FROM r FULL JOIN c USING (target_id) WHERE r.s IS DISTINCT FROM c.s""",
    "slots targets",
)
def binding_equality(t):
    from ..functions.ids import sha256_hex, tree_digest

    links = graph.material_targets(t.slots, t.targets)

    def digests(rows):
        h = sha256_hex(F.concat_ws(":", "bundle_key", "material_path_id"))
        return tree_digest(rows, ["target_id"], h).drop("n")

    recorded = digests(links.filter("material_path_id % 50 <> 0"))
    current = digests(links.filter("material_path_id % 70 <> 0"))
    return gates.compare_evidence(recorded, current, "target_id", ["digest"])


_EV = """r AS (SELECT o_orderkey AS target_id, o_orderstatus AS action, o_orderpriority AS texture, 'b'||o_custkey AS bundle, sha256(o_orderkey::VARCHAR) AS sha FROM orders WHERE o_orderkey%41<>0),
    c AS (SELECT o_orderkey AS target_id, CASE WHEN o_orderkey%7=0 THEN 'X' ELSE o_orderstatus END AS action, o_orderpriority AS texture, CASE WHEN o_orderkey%11=0 THEN NULL ELSE 'b'||o_custkey END AS bundle,
      sha256(o_orderkey::VARCHAR||CASE WHEN o_orderkey%13=0 THEN 'x' ELSE '' END) AS sha FROM orders WHERE o_orderkey%43<>0)"""
_EVI = """SELECT target_id, unnest(list_filter([CASE WHEN r.sha IS NULL THEN 'not_recorded' END, CASE WHEN c.sha IS NULL THEN 'not_current' END,
    CASE WHEN r.sha IS NOT NULL AND c.sha IS NOT NULL AND r.action IS DISTINCT FROM c.action THEN 'action' END, CASE WHEN r.sha IS NOT NULL AND c.sha IS NOT NULL AND r.bundle IS DISTINCT FROM c.bundle THEN 'bundle' END,
    CASE WHEN r.sha IS NOT NULL AND c.sha IS NOT NULL AND r.sha<>c.sha THEN 'sha' END], lambda v: v IS NOT NULL)) AS issue FROM r FULL JOIN c USING (target_id)"""


def _evidence(t):
    k = F.col("o_orderkey")
    recorded = t.orders.filter(k % 41 != 0).select(
        k.alias("target_id"), F.col("o_orderstatus").alias("action"), F.col("o_orderpriority").alias("texture"),
        F.concat(F.lit("b"), "o_custkey").alias("bundle"), F.sha2(k.cast("string"), 256).alias("sha"),
    )
    current = t.orders.filter(k % 43 != 0).select(
        k.alias("target_id"), F.when(k % 7 == 0, "X").otherwise(F.col("o_orderstatus")).alias("action"), F.col("o_orderpriority").alias("texture"),
        F.when(k % 11 != 0, F.concat(F.lit("b"), "o_custkey")).alias("bundle"),
        F.sha2(F.concat(k.cast("string"), F.when(k % 13 == 0, "x").otherwise("")), 256).alias("sha"),
    )
    return recorded, current


@GATES.query("j31_profile_review_agreement", f"WITH {_EV} {_EVI}")
def profile_review(t):
    return gates.compare_evidence(*_evidence(t), "target_id", ["action", "texture", "bundle", "sha"])


@GATES.query(
    "j36_approval_evidence",
    f"WITH {_EV} SELECT target_id, r.sha=c.sha AND r.bundle IS NOT DISTINCT FROM c.bundle AS approved FROM r JOIN c USING (target_id)",
)
def approval_evidence(t):
    recorded, current = _evidence(t)
    issues = gates.compare_evidence(recorded, current, "target_id", ["bundle", "sha"]).select("target_id").distinct()
    both = recorded.select("target_id").join(current.select("target_id"), "target_id")
    return both.join(issues.withColumn("_i", F.lit(True)), "target_id", "left").select("target_id", F.col("_i").isNull().alias("approved"))


_STAGES = "sg AS (SELECT target_id, stage, arg_max(status, ts) AS status, arg_max(evidence_sha256, ts) AS evidence_sha256 FROM stage_log GROUP BY 1,2)"


@GATES.query(
    "a15_stage_crosstab",
    f"""WITH {_STAGES} SELECT stage, count(*) FILTER (status='pass') AS pass, count(*) FILTER (status='fail') AS fail, count(*) FILTER (status='pending') AS pending FROM sg GROUP BY 1""",
    "stage_log",
)
def stage_crosstab(t):
    return gates.stage_crosstab(gates.latest_stages(t.stage_log), ["pass", "fail", "pending"])


@GATES.query(
    "a15_approval_progress",
    f"""WITH {_STAGES}, ap AS (SELECT DISTINCT target_id FROM sg WHERE stage='purchase' AND status='pass') SELECT target_id,
    CASE WHEN target_id%9=0 THEN 'preserve' WHEN target_id IN (SELECT target_id FROM ap) THEN 'approved' ELSE 'pending' END AS state FROM (SELECT DISTINCT target_id FROM stage_log)""",
    "stage_log",
)
def approval_progress(t):
    stages = gates.latest_stages(t.stage_log)
    targets = t.stage_log.select("target_id").distinct().withColumn("action", F.when(F.col("target_id") % 9 == 0, "preserve").otherwise("localize"))
    return gates.approval_progress(targets, stages.filter("stage = 'purchase' and status = 'pass'"))


@GATES.query(
    "a16_approval_rollup",
    """WITH t AS (SELECT DISTINCT o_custkey AS target_id FROM orders), r AS (SELECT DISTINCT o_custkey AS target_id, o_custkey%50<>0 AS passed FROM orders WHERE o_custkey%31<>0)
    SELECT count(*) AS target_count, count(*) FILTER (t.target_id%9=0) AS preserved_count, count(*) FILTER (t.target_id%9<>0 AND passed IS NOT NULL) AS approved_count,
    count(*) FILTER (t.target_id%9<>0 AND passed IS NULL) AS missing_count, bool_and(t.target_id%9=0 OR coalesce(passed,false)) AS passed FROM t LEFT JOIN r USING (target_id)""",
)
def approval_rollup(t):
    c = F.col("target_id")
    targets = t.orders.select(F.col("o_custkey").alias("target_id")).distinct()
    reports = targets.filter(c % 31 != 0).withColumn("passed", c % 50 != 0)
    return gates.approval_rollup(targets.withColumn("action", F.when(c % 9 == 0, "preserve").otherwise("localize")), reports)


_PANEL = """pn AS (SELECT target_id, face, rotation_deg, max(attempts) AS attempts, min(region_id) AS fr FROM (SELECT *, CASE WHEN region_id%3=0 THEN 0 ELSE occurrences END AS attempts FROM regions) GROUP BY 1,2,3),
    pi AS (SELECT *, 'panel-'||lpad(row_number() OVER (PARTITION BY target_id ORDER BY fr)::VARCHAR,2,'0')||'-'||substr(sha256(face||chr(0)||rotation_deg::DOUBLE::VARCHAR),1,8) AS panel_id FROM pn)"""


def _panels(t):
    attempts = t.regions.filter("region_id % 3 <> 0").select("region_id", F.col("occurrences").alias("attempts"))
    return gates.panel_attempts(t.regions, attempts)


@GATES.query("a18_panel_attempts", f"WITH {_PANEL} SELECT target_id, face, rotation_deg, attempts, panel_id FROM pi", "regions")
def panel_attempts(t):
    return _panels(t)


_JOBS = f"""{_PANEL}, jb AS (SELECT event_id AS job_id, user_id AS target_id, (['front','back','side'])[event_id%3+1] AS face, 90*(k%4) AS rotation_deg, k%5 AS attempt, k%2=0 AS generated FROM events_k),
    jp AS (SELECT jb.*, pi.panel_id AS job_panel FROM jb LEFT JOIN pi ON pi.target_id=jb.target_id AND pi.face='front' AND pi.rotation_deg=jb.rotation_deg),
    lc AS (SELECT pi.target_id, pi.panel_id, pi.attempts, greatest(count(DISTINCT jp.job_id), coalesce(max(jp.attempt),0)) AS loc FROM pi LEFT JOIN jp ON jp.target_id=pi.target_id AND jp.generated
      AND (jp.job_panel=pi.panel_id OR (jp.face=pi.face AND jp.rotation_deg=pi.rotation_deg)) GROUP BY 1,2,3),
    cu AS (SELECT target_id, panel_id, attempts, greatest(attempts, loc) AS current_attempts FROM lc)"""


def _current_attempts(t):
    from .adapters import pick

    panels = _panels(t)
    e = F.col("event_id")
    jobs = t.events_k.select(
        e.alias("job_id"), F.col("user_id").alias("target_id"), pick(["front", "back", "side"], e % 3).alias("face"),
        (F.lit(90) * (F.col("k") % 4)).alias("rotation_deg"), (F.col("k") % 5).alias("attempt"), (F.col("k") % 2 == 0).alias("generated"),
    )
    fronts = panels.filter("face = 'front'").select("target_id", "rotation_deg", "panel_id")
    return gates.local_attempts(panels, jobs.join(fronts, ["target_id", "rotation_deg"], "left"))


@GATES.query("j32_local_attempts", f"WITH {_JOBS} SELECT * FROM cu", "regions events_k")
def local_attempts(t):
    return _current_attempts(t)


_BUDGET = f"""{_JOBS}, lg AS (SELECT target_id, max(occurrences)-1 AS l FROM regions WHERE region_id%2=0 GROUP BY 1),
    bu AS (SELECT coalesce(p.target_id, lg.target_id) AS target_id, greatest(coalesce(l,0), coalesce(top,0)) AS recorded_attempts, coalesce(l,0)>=2 OR coalesce(allp,false) AS exhausted
      FROM (SELECT target_id, max(current_attempts) AS top, bool_and(current_attempts>=2) AS allp FROM cu GROUP BY 1) p FULL JOIN lg ON p.target_id=lg.target_id)"""


def _budget(t):
    legacy = t.regions.filter("region_id % 2 = 0").groupBy("target_id").agg((F.max("occurrences") - 1).alias("legacy_attempts"))
    return gates.attempt_budget(_current_attempts(t), legacy)


@GATES.query("a63_attempt_budget", f"WITH {_BUDGET} SELECT * FROM bu", "regions events_k")
def attempt_budget(t):
    return _budget(t)


_READY = f"""{_BUDGET}, rd AS (SELECT target_id, CASE WHEN target_id%9=0 THEN 'preserve' WHEN target_id%11=0 THEN 'record-or-source-error' WHEN target_id%3=0 AND target_id%4=0 THEN 'analysis-and-masks-required'
      WHEN target_id%3=0 THEN 'analysis-required' WHEN target_id%4=0 THEN 'masks-required' WHEN exhausted THEN 'attempt-budget-exhausted' ELSE 'ready' END AS status,
      concat_ws('|', CASE WHEN target_id%9<>0 AND target_id%11=0 THEN 'record-or-source-error' END, CASE WHEN target_id%9<>0 AND target_id%11<>0 AND target_id%3=0 THEN 'analysis-required' END,
      CASE WHEN target_id%9<>0 AND target_id%11<>0 AND target_id%4=0 THEN 'masks-required' END, CASE WHEN target_id%9<>0 AND exhausted THEN 'attempt-budget-exhausted' END) AS issue_codes FROM bu)"""


def _ready(t):
    i = F.col("target_id")
    flags = _budget(t).withColumns(
        {
            "action": F.when(i % 9 == 0, "preserve").otherwise("localize"), "record_error": i % 11 == 0,
            "analysis_error": i % 3 == 0, "mask_error": i % 4 == 0,
        }
    )
    return gates.readiness(flags)


@GATES.query("a17_readiness", f"WITH {_READY} SELECT * FROM rd", "regions events_k")
def readiness(t):
    return _ready(t)


@GATES.query(
    "j37_preparation_request",
    f"""WITH {_READY}, st AS (SELECT r.path, substr(r.target_id,2)::BIGINT AS target_id, r.sha256, CASE WHEN c.sha256 IS NULL THEN 'missing' WHEN c.sha256=r.sha256 THEN 'ok' ELSE 'changed' END AS state
      FROM recorded_artifacts r LEFT JOIN current_artifacts c USING (path)),
    pd AS ({tree_digest_sql("(SELECT *, sha256(path||'|'||sha256) AS h FROM st)", ['target_id'], out='dg', drifted="state<>'ok'")})
    SELECT target_id, status, CASE status WHEN 'record-or-source-error' THEN 'source-and-review-audit' WHEN 'analysis-required' THEN 'analysis' WHEN 'masks-required' THEN 'masks'
      WHEN 'analysis-and-masks-required' THEN 'analysis|masks' ELSE 'attempt-budget-approval' END AS requested_work, coalesce(drifted,0) AS drifted_pins,
    sha256(concat_ws('|', target_id, status, coalesce(dg,''))) AS request_digest FROM rd LEFT JOIN pd USING (target_id) WHERE status NOT IN ('preserve','ready')""",
    "regions events_k recorded_artifacts current_artifacts",
)
def preparation(t):
    pins = graph.hash_pins(t.recorded_artifacts, t.current_artifacts).withColumn(
        "target_id", F.substring("target_id", 2, 20).cast("long")
    )
    return gates.preparation_request(_ready(t), pins)


@GATES.query(
    "j39_panel_ocr_binding",
    """WITH r AS (SELECT target_id||face AS panel_id, region_id, text, rotation_deg FROM regions),
    x AS (SELECT panel_id, region_id, text AS expected_text, region_id%20<>0 AS matched, CASE WHEN rotation_deg=270 AND region_id%16=0 THEN 'fuzzy' ELSE 'nfc-literal' END AS match_mode FROM r WHERE region_id%28<>0),
    p AS (SELECT panel_id, count(*) AS regions, count(*) FILTER (coalesce(x.matched AND match_mode='nfc-literal', false)) AS bound_regions FROM r LEFT JOIN x USING (panel_id, region_id) GROUP BY 1)
    SELECT *, length(panel_id)%5<>0 AND regions=bound_regions AS bound FROM p""",
    "regions",
)
def panel_binding(t):
    regions = t.regions.select(F.concat("target_id", "face").alias("panel_id"), "region_id", "text", "rotation_deg")
    r = F.col("region_id")
    results = regions.filter(r % 28 != 0).select(
        "panel_id", "region_id", F.col("text").alias("expected_text"), (r % 20 != 0).alias("matched"),
        F.when((F.col("rotation_deg") == 270) & (r % 16 == 0), "fuzzy").otherwise("nfc-literal").alias("match_mode"),
    )
    panels = regions.select("panel_id").distinct().select(
        "panel_id", F.sha2("panel_id", 256).alias("image_sha256"),
        F.when(F.length("panel_id") % 5 == 0, "x").otherwise(F.sha2("panel_id", 256)).alias("panel_sha256"),
    )
    return gates.panel_ocr_binding(panels, regions.drop("rotation_deg"), results)


@GATES.query(
    "f23_panel_transforms",
    """SELECT region_id AS panel_id, concat_ws('|', CASE WHEN region_id%7=0 THEN 'crop_misses_region' END, CASE WHEN region_id%3=0 AND rotation_deg<>0 THEN 'deskew_rotation' END,
    CASE WHEN region_id%5=0 AND rotation_deg<>0 THEN 'inverse_rotation' END, CASE WHEN region_id%9=0 THEN 'negative_padding' END, CASE WHEN region_id%11=0 THEN 'source_rotation' END) AS issues FROM regions""",
    "regions",
)
def panel_transforms(t):
    r, rot = F.col("region_id"), F.col("rotation_deg").cast("double")
    panels = t.regions.select(
        r.alias("panel_id"), rot.alias("rotation_deg"), "x0", "y0", "x1", "y1",
        F.when(r % 7 == 0, F.col("x0") + 1).otherwise(F.col("x0") - 4).alias("crop_x0"), (F.col("y0") - 4).alias("crop_y0"),
        (F.col("x1") + 4).alias("crop_x1"), (F.col("y1") + 4).alias("crop_y1"), F.when(r % 9 == 0, -1).otherwise(4).alias("padding"),
        F.when(r % 11 == 0, rot + 1).otherwise(rot).alias("source_rotation"), F.when(r % 3 == 0, -rot).otherwise(rot).alias("deskew_rotation"),
        F.when(r % 5 == 0, rot).otherwise(-rot).alias("inverse_rotation"),
    )
    return gates.panel_transform_issues(panels)


@GATES.query(
    "a49_release_id",
    f"""WITH b AS ({tree_digest_sql("(SELECT sha256(path||'|'||sha256) AS h FROM current_artifacts)", [], out='d')}),
    r AS ({tree_digest_sql("(SELECT sha256(target_id||'|'||sha256) AS h FROM recorded_artifacts)", [], out='d')})
    SELECT substr(sha256('bundles='||b.d||';reviews='||r.d||'#profile=p1;report=r1'),1,16) AS release_id FROM b, r""",
    "current_artifacts recorded_artifacts",
)
def release(t):
    bundles = t.current_artifacts.select(F.col("path").alias("name"), "sha256")
    reviews = t.recorded_artifacts.select(F.col("target_id").alias("name"), "sha256")
    return gates.release_id({"bundles": bundles, "reviews": reviews}, {"profile": "p1", "report": "r1"})


@GATES.query(
    "a53_run_rollup",
    """SELECT o_custkey AS grp, count(*) AS items, count(*) FILTER (o_orderkey%29<>0) AS passed_items, bool_and(o_orderkey%29<>0) AS passed, bool_or(o_orderstatus='P') AS partial,
    min(o_orderkey) AS first_id, max(o_orderkey) AS last_id FROM orders GROUP BY 1""",
)
def rollup(t):
    rows = t.orders.select(
        F.col("o_custkey").alias("grp"), F.col("o_orderkey").alias("item_id"), (F.col("o_orderkey") % 29 != 0).alias("passed"), (F.col("o_orderstatus") == "P").alias("partial")
    )
    return gates.run_rollup(rows, "grp")


_REPL = """rp AS (SELECT bundle_key, texture, CASE WHEN path_id%50=0 THEN 'alt/' ELSE 'img/' END||texture AS image, CASE WHEN path_id%2=0 THEN 'normal' ELSE 'gloss' END AS role, 't'||(path_id%30) AS target_id FROM texture_names),
    g AS (SELECT bundle_key, texture, min(image) AS image, count(DISTINCT image) AS images, min(role) AS role, count(DISTINCT target_id) AS coverages FROM rp GROUP BY 1,2)"""


def _replacements(t):
    i = F.col("path_id")
    rows = t.texture_names.select(
        "bundle_key", "texture", F.concat(F.when(i % 50 == 0, "alt/").otherwise("img/"), "texture").alias("image"),
        F.when(i % 2 == 0, "normal").otherwise("gloss").alias("role"), F.concat(F.lit("t"), i % 30).alias("target_id"),
    )
    return gates.replacements(rows)


@GATES.query("a59_replacements", f"WITH {_REPL} SELECT bundle_key, texture, image, role, coverages FROM g WHERE images=1", "texture_names")
def replacements(t):
    return _replacements(t)[0]


@GATES.query("a59_duplicate_replacements", f"WITH {_REPL} SELECT bundle_key, texture, images FROM g WHERE images>1", "texture_names")
def duplicate_replacements(t):
    return _replacements(t)[1]


@GATES.query(
    "a62_candidate_verdict",
    f"""WITH {_PAIRS}, m AS (SELECT texture_id, count(*) FILTER (ch) AS c, count(*) FILTER (ba<>aa) AS al, count(*) FILTER (ch AND NOT editable) AS o, count(*) FILTER (ch AND protected) AS p, count(*) FILTER (ch AND seam_guard) AS s FROM pr GROUP BY 1)
    SELECT texture_id, al=0 AND c>0 AND o=0 AND p=0 AND s=0 AND texture_id%5<>0 AND texture_id%7<>0 AND texture_id%3<>0 AND texture_id%11<>0 AS passed FROM m""",
    _NEED,
)
def verdict(t):
    i = F.col("texture_id")
    measured = texels.change_measurements(_pairs(t)).withColumns(
        {
            "padding_mismatch_pixels": F.when(i % 5 == 0, 1).otherwise(0), "foreign_detections": F.when(i % 7 == 0, 2).otherwise(0),
            "expected_text_matched": i % 3 != 0, "duplicate_text": i % 11 == 0,
        }
    )
    return gates.candidate_verdict(measured)
