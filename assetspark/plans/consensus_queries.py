"""Overlap, clustering, voting and region matching."""

from pyspark.sql import functions as F

from ..functions import boxes
from ..functions.text import literal_text
from ..operators import consensus
from .adapters import READING_WORDS, pick
from .adapters_sql import agreement_sql
from .adapters_sql import pick as pick_sql
from .registry import Registry

CONSENSUS = Registry()

_INTER = "greatest(0, least({a}x1,{b}x1)-greatest({a}x0,{b}x0))*greatest(0, least({a}y1,{b}y1)-greatest({a}y0,{b}y0))"
_AREA = "(({p}x1-{p}x0)*({p}y1-{p}y0))"


def _geometry(a: str, b: str) -> tuple[str, str, str]:
    inter = _INTER.format(a=a, b=b)
    aa, ab = _AREA.format(p=a), _AREA.format(p=b)
    iou = f"(({inter})::DOUBLE/greatest(1, {aa}+{ab}-({inter})))"
    ios = f"(({inter})::DOUBLE/greatest(1, least({aa},{ab})))"
    same = f"({iou}>=0.55 OR ({a}key<>'' AND {b}key<>'' AND (contains({a}key,{b}key) OR contains({b}key,{a}key)) AND {ios}>=0.85))"
    return iou, ios, same


_IOU, _IOS, _SAME = _geometry("l.", "r.")
_KEYED = f"k AS (SELECT *, {agreement_sql('text')} AS key FROM readings)"

_CLUSTERS = f"""{_KEYED},
    o AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY confidence DESC, seq) AS pos FROM k),
    e AS (SELECT l.image_id, l.seq AS later, r.seq AS earlier FROM o l JOIN o r ON l.image_id=r.image_id AND r.pos<l.pos AND {_SAME}),
    reach AS (SELECT image_id, seq AS node, seq AS cur FROM o UNION SELECT q.image_id, q.node, e.earlier FROM reach q JOIN e ON e.later=q.cur),
    c AS (SELECT k.*, b.cluster_id FROM k JOIN (SELECT q.node, arg_min(o.seq, o.pos) AS cluster_id
      FROM reach q JOIN o ON o.seq=q.cur GROUP BY q.node) b ON k.seq=b.node)"""

_CONSENSUS = f"""{_CLUSTERS},
    v1 AS (SELECT image_id, cluster_id, key, row_number() OVER (PARTITION BY image_id, cluster_id ORDER BY count(DISTINCT model_signature) DESC,
      count(DISTINCT engine) DESC, max(confidence) DESC, length(key) DESC, arg_min(seq, {{'c': -confidence, 's': seq}})) AS rn
      FROM c WHERE key<>'' GROUP BY image_id, cluster_id, key),
    a AS (SELECT c.* FROM c JOIN v1 USING (image_id, cluster_id, key) WHERE rn=1),
    v2 AS (SELECT image_id, cluster_id, rotation_deg, row_number() OVER (PARTITION BY image_id, cluster_id ORDER BY count(DISTINCT model_signature) DESC,
      count(DISTINCT engine) DESC, max(confidence) DESC, rotation_deg) AS rn FROM a GROUP BY image_id, cluster_id, rotation_deg),
    pool AS (SELECT a.* FROM a JOIN v2 USING (image_id, cluster_id, rotation_deg) WHERE rn=1
      UNION ALL SELECT c.* FROM c WHERE NOT EXISTS (SELECT 1 FROM v1 WHERE v1.image_id=c.image_id AND v1.cluster_id=c.cluster_id)),
    best AS (SELECT * FROM pool QUALIFY row_number() OVER (PARTITION BY image_id, cluster_id ORDER BY confidence DESC, seq)=1)"""

_ALTS = f"""{_CONSENSUS},
    alt AS (SELECT *, row_number() OVER (PARTITION BY image_id, cluster_id ORDER BY confidence DESC, seq) AS position FROM (
      SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY image_id, cluster_id, model_signature, key ORDER BY confidence DESC, seq)=1)
      QUALIFY position<=8)"""


def _clustered(t):
    return consensus.cluster_readings(t.readings)


@CONSENSUS.query(
    "j18_box_overlap_pairs",
    f"""WITH {_KEYED}, s AS (SELECT image_id, x0,y0,x1,y1,key, min(seq) AS seq, count(*) AS n FROM k GROUP BY ALL)
    SELECT l.image_id, l.seq AS l_seq, r.seq AS r_seq, l.n AS l_n, r.n AS r_n, {_IOU} AS iou, {_IOS} AS over_smaller
    FROM s l JOIN s r ON l.image_id=r.image_id AND l.seq<r.seq AND {_SAME}""",
    "readings",
)
def box_pairs(t):
    return consensus.same_region_pairs(t.readings).select(
        "image_id", "l_seq", "r_seq", "l_n", "r_n", "iou", "over_smaller"
    )


@CONSENSUS.query("a09_greedy_clusters", f"WITH RECURSIVE {_CLUSTERS} SELECT image_id, seq, cluster_id FROM c", "readings")
def clusters(t):
    return consensus.greedy_clusters(t.readings)


@CONSENSUS.query(
    "a07_consensus_reading",
    f"WITH RECURSIVE {_CONSENSUS} SELECT image_id, cluster_id, seq, text, confidence, rotation_deg, engine FROM best",
    "readings",
)
def consensus_reading(t):
    return consensus.consensus(_clustered(t)).select(
        "image_id", "cluster_id", "seq", "text", "confidence", "rotation_deg", "engine"
    )


@CONSENSUS.query(
    "k03_cluster_alternatives",
    f"WITH RECURSIVE {_ALTS} SELECT image_id, cluster_id, model_signature, seq, text, confidence, position FROM alt",
    "readings",
)
def cluster_alternatives(t):
    return consensus.alternatives(_clustered(t)).select(
        "image_id", "cluster_id", "model_signature", "seq", "text", "confidence", "position"
    )


@CONSENSUS.query(
    "a08_review_states",
    f"""WITH RECURSIVE {_ALTS}, j AS (SELECT alt.*, best.key AS bk, best.confidence AS bc FROM alt JOIN best USING (image_id, cluster_id)),
    s AS (SELECT image_id, cluster_id, count(DISTINCT engine) FILTER (key=bk)>=2 AS engine_agreement,
      count(DISTINCT key) FILTER (key<>'' AND confidence>=greatest(0.45, bc*0.65))>1 AS conflicting_readings FROM j GROUP BY 1,2)
    SELECT *, CASE WHEN conflicting_readings THEN 'conflict' WHEN engine_agreement THEN 'agreement' ELSE 'single_engine' END AS review_state FROM s""",
    "readings",
)
def review_states(t):
    clustered = _clustered(t)
    return consensus.review_states(consensus.consensus(clustered), consensus.alternatives(clustered))


@CONSENSUS.query(
    "w02_region_numbers",
    f"""WITH RECURSIVE {_CONSENSUS} SELECT image_id, cluster_id, 'ocr-'||lpad(row_number() OVER (PARTITION BY image_id ORDER BY y0, x0, seq)::VARCHAR, 3, '0') AS region_label
    FROM best""",
    "readings",
)
def region_numbers(t):
    return consensus.number_regions(consensus.consensus(_clustered(t)), "ocr").select(
        "image_id", "cluster_id", "region_label"
    )


_VISUAL = "x1-x0>=4 AND y1-y0>=4 AND confidence>=0.45 AND NOT (script='other' AND confidence<0.75)"


@CONSENSUS.query("p13_visual_eligibility", f"SELECT image_id, seq FROM readings WHERE {_VISUAL}", "readings")
def visual_eligibility(t):
    return t.readings.filter(consensus.visual_candidate()).select("image_id", "seq")


@CONSENSUS.query(
    "p14_reference_eligibility",
    "SELECT image_id, seq FROM readings WHERE contains(script,'latin') AND confidence>=0.75 AND trim(text)<>''",
    "readings",
)
def reference_eligibility(t):
    # the driver texts are Latin, so the Latin script stands in for Korean
    return t.readings.filter(consensus.korean_candidate("latin")).select("image_id", "seq")


@CONSENSUS.query(
    "p15_valid_readings",
    "SELECT asset_id, seq FROM detections WHERE confidence>=0.3 AND trim(text)<>''",
    "detections",
)
def valid_readings(t):
    return t.detections.filter(consensus.valid_reading(0.3)).select("asset_id", "seq")


def _suppression_sql(where: str, order: str, covers: str) -> str:
    return f"""WITH RECURSIVE o AS (SELECT image_id, seq, confidence, text, x0, y0, x1, y1,
      row_number() OVER (PARTITION BY image_id ORDER BY {order}) AS pos FROM readings WHERE {where}),
    w AS (SELECT image_id, 0::BIGINT AS pos, []::STRUCT(seq BIGINT, confidence DOUBLE, text VARCHAR, x0 BIGINT, y0 BIGINT, x1 BIGINT, y1 BIGINT)[] AS done
      FROM (SELECT DISTINCT image_id FROM o)
      UNION ALL SELECT o.image_id, o.pos, CASE WHEN len(list_filter(w.done, lambda d: {covers}))>0 THEN w.done
        ELSE list_append(w.done, struct_pack(seq:=o.seq, confidence:=o.confidence, text:=o.text, x0:=o.x0::BIGINT, y0:=o.y0::BIGINT, x1:=o.x1::BIGINT, y1:=o.y1::BIGINT)) END
      FROM w JOIN o ON o.image_id=w.image_id AND o.pos=w.pos+1),
    l AS (SELECT image_id, arg_max(done, pos) AS done FROM w GROUP BY image_id),
    u AS (SELECT image_id, unnest(done) AS d FROM l)
    SELECT image_id, d.seq AS seq, d.x0 AS x0, d.y0 AS y0 FROM u"""


_AREA_DESC = "(x1-x0)*(y1-y0) DESC"
_COVER = _geometry("o.", "d.")[1]


@CONSENSUS.query(
    "a10_visual_suppression",
    _suppression_sql(_VISUAL, f"{_AREA_DESC}, confidence DESC, seq", f"{_COVER}>=0.78 AND d.confidence>=o.confidence*0.7"),
    "readings",
)
def visual_suppression(t):
    return consensus.visual_regions(t.readings).select("image_id", "seq", "x0", "y0")


@CONSENSUS.query(
    "a11_reference_suppression",
    _suppression_sql(
        "contains(script,'latin') AND confidence>=0.75 AND trim(text)<>''",
        f"{_AREA_DESC}, length(text) DESC, confidence DESC, seq",
        f"{_COVER}>=0.8 AND contains(d.text, o.text)",
    ),
    "readings",
)
def reference_suppression(t):
    return consensus.reference_regions(t.readings, "latin").select("image_id", "seq", "x0", "y0")


_EXPECTED = f"""x AS (SELECT DISTINCT region_id, {pick_sql(READING_WORDS, 'region_id%7')}||' '||{pick_sql(READING_WORDS, '(region_id//7)%7')} AS expected_text FROM region_calls)"""
_LINES = """tk AS (SELECT *, (seq%8)//3 AS line, row_number() OVER (PARTITION BY call_id ORDER BY (seq%8)//3, cx, seq)-1 AS ordinal FROM region_calls)"""


def _expected(t):
    r = F.col("region_id")
    words = F.concat(pick(READING_WORDS, r % 7), F.lit(" "), pick(READING_WORDS, F.call_function("div", r, F.lit(7)) % 7))
    return t.region_calls.select("region_id").distinct().withColumn("expected_text", words)


def _tokens(t):
    return t.region_calls.join(consensus.reading_order(t.region_calls), ["call_id", "seq"])


@CONSENSUS.query("w04_reading_order", f"WITH {_LINES} SELECT call_id, seq, line, ordinal FROM tk", "region_calls")
def reading_order(t):
    return consensus.reading_order(t.region_calls)


@CONSENSUS.query(
    "w05_expected_spans",
    f"""WITH {_LINES}, {_EXPECTED}, sp AS (SELECT a.call_id, a.region_id, a.ordinal AS first, b.ordinal AS last,
      string_agg(CASE WHEN m.ordinal=a.ordinal THEN '' WHEN m.line=p.line THEN ' ' ELSE chr(10) END || m.text, '' ORDER BY m.ordinal) AS txt,
      min(m.confidence) AS confidence
      FROM tk a JOIN tk b ON a.call_id=b.call_id AND b.ordinal>=a.ordinal JOIN tk m ON m.call_id=a.call_id AND m.ordinal BETWEEN a.ordinal AND b.ordinal
      LEFT JOIN tk p ON p.call_id=m.call_id AND p.ordinal=m.ordinal-1 GROUP BY 1,2,3,4)
    SELECT call_id, sp.region_id, expected_text, first, last, confidence FROM sp JOIN x ON x.region_id=sp.region_id AND txt=expected_text""",
    "region_calls",
)
def expected_spans(t):
    tokens = _tokens(t).withColumn("text", F.btrim(literal_text(F.col("text"))))
    return consensus.spans_equal_to(tokens, _expected(t))


_SPANS = f"""{_LINES}, sp AS (SELECT a.call_id, a.region_id, a.ordinal AS first, b.ordinal AS last,
      string_agg(CASE WHEN m.ordinal=a.ordinal THEN '' WHEN m.line=p.line THEN ' ' ELSE chr(10) END || m.text, '' ORDER BY m.ordinal) AS text,
      round(min(m.confidence),6) AS confidence, list(m.text ORDER BY m.ordinal) AS components
      FROM tk a JOIN tk b ON a.call_id=b.call_id AND b.ordinal>a.ordinal JOIN tk m ON m.call_id=a.call_id AND m.ordinal BETWEEN a.ordinal AND b.ordinal
      LEFT JOIN tk p ON p.call_id=m.call_id AND p.ordinal=m.ordinal-1 GROUP BY 1,2,3,4)"""


@CONSENSUS.query("w05_all_spans", f"WITH {_SPANS} SELECT * FROM sp", "region_calls")
def all_spans(t):
    return consensus.composite_spans(_tokens(t).select("call_id", "region_id", "ordinal", "line", "text", "confidence"))


@CONSENSUS.query(
    "w05_region_readings",
    f"""WITH {_SPANS}, un AS (SELECT call_id, ordinal AS first, ordinal AS last, text, confidence, NULL::VARCHAR[] AS components FROM tk
      UNION ALL SELECT call_id, first, last, text, confidence, components FROM sp),
    nm AS (SELECT un.*, c.region_id, c.engine, c.model_signature, c.variant FROM un JOIN tk ON tk.call_id=un.call_id AND tk.ordinal=un.first JOIN region_calls c ON c.call_id=tk.call_id AND c.seq=tk.seq)
    SELECT region_id, model_signature, variant, text, call_id, engine, first, last, confidence, components FROM nm
    QUALIFY row_number() OVER (PARTITION BY region_id, model_signature, variant, text ORDER BY confidence DESC, call_id, components IS NOT NULL, first, last)=1""",
    "region_calls",
)
def region_readings(t):
    return consensus.region_readings(_tokens(t))


@CONSENSUS.query(
    "w06_call_composites",
    """SELECT call_id, string_agg(trim(text), ' ' ORDER BY seq) AS text, round(min(confidence),6) AS confidence, count(*) AS components
    FROM region_calls GROUP BY call_id HAVING count(*)>1""",
    "region_calls",
)
def composites(t):
    return consensus.call_composites(t.region_calls)


@CONSENSUS.query(
    "a12_best_per_model",
    """SELECT region_id, engine, model_signature, seq, text, confidence FROM region_calls
    QUALIFY row_number() OVER (PARTITION BY region_id, engine, model_signature ORDER BY confidence DESC, seq)=1""",
    "region_calls",
)
def best_per_model(t):
    rows = t.region_calls.select("region_id", "engine", "model_signature", "seq", "text", "confidence")
    return consensus.reading_store(rows, ["region_id", "engine", "model_signature"])


@CONSENSUS.query(
    "a13_reading_store",
    """SELECT region_id, model_signature, variant, text, seq, confidence FROM region_calls
    QUALIFY row_number() OVER (PARTITION BY region_id, model_signature, variant, text ORDER BY confidence DESC, seq)=1""",
    "region_calls",
)
def reading_store(t):
    rows = t.region_calls.select("region_id", "model_signature", "variant", literal_text(F.col("text")).alias("text"), "seq", "confidence")
    return consensus.reading_store(rows, ["region_id", "model_signature", "variant", "text"])



@CONSENSUS.query(
    "a12_region_match",
    f"""WITH {_EXPECTED}, w AS (SELECT region_id, {pick_sql(READING_WORDS, 'region_id%7')} AS e FROM x)
    SELECT w.region_id, e AS expected_text, coalesce(bool_or(text=e), false) AS matched,
    coalesce(string_agg(DISTINCT engine, '|' ORDER BY engine) FILTER (text=e), '') AS matching_engines
    FROM w LEFT JOIN region_calls r ON r.region_id=w.region_id GROUP BY 1,2""",
    "region_calls",
)
def region_match(t):
    expected = t.region_calls.select("region_id").distinct().withColumn(
        "expected_text", pick(READING_WORDS, F.col("region_id") % 7)
    )
    return consensus.region_matches(t.region_calls, expected)


@CONSENSUS.query(
    "k03_top_readings",
    """SELECT image_id, seq, row_number() OVER (PARTITION BY image_id ORDER BY confidence DESC, seq) AS position
    FROM readings QUALIFY position<=16""",
    "readings",
)
def top_readings(t):
    return consensus.top_readings(t.readings, "image_id").select("image_id", "seq", "position")


_COUNTS = """WITH cap AS (SELECT * FROM (VALUES ('Facts', true), ('Beer', true), ('12', false)) v(text, capable)),
    s AS (SELECT text, sum(occurrences)::BIGINT AS expected, sum(CASE WHEN ocr_required IS NOT NULL THEN occurrences ELSE 0 END)::BIGINT AS ex,
      sum(CASE WHEN ocr_required THEN occurrences ELSE 0 END)::BIGINT AS er FROM regions GROUP BY text)
    SELECT s.text, expected, er + CASE WHEN coalesce(capable,false) THEN expected-ex ELSE 0 END AS required FROM s LEFT JOIN cap USING (text)"""


@CONSENSUS.query("a14_occurrence_counts", _COUNTS, "regions")
def occurrences(t):
    capable = t.spark.createDataFrame([("Facts", True), ("Beer", True), ("12", False)], "text string, capable boolean")
    return consensus.occurrence_counts(t.regions, capable)


@CONSENSUS.query(
    "a14_count_comparison",
    """WITH e AS (SELECT text, sum(occurrences)::BIGINT AS expected FROM regions WHERE text<>'12' GROUP BY 1),
    a AS (SELECT text, count(*) AS actual FROM regions WHERE text<>'Stop' GROUP BY 1)
    SELECT text, coalesce(expected,0) AS expected, coalesce(actual,0) AS actual, expected IS NOT DISTINCT FROM actual AS equal,
    expected IS NOT NULL AND coalesce(actual,0)>coalesce(expected,0) AS duplicate FROM e FULL JOIN a USING (text)""",
    "regions",
)
def count_comparison(t):
    expected = t.regions.filter("text <> '12'").groupBy("text").agg(F.sum("occurrences").alias("expected"))
    actual = t.regions.filter("text <> 'Stop'").groupBy("text").agg(F.count("*").alias("actual"))
    return consensus.compare_counts(expected, actual)


@CONSENSUS.query(
    "j24_region_completeness",
    """WITH r AS (SELECT region_id, needs_ocr_fallback AS matched, CASE WHEN rotation_deg=90 THEN 'fuzzy' ELSE 'nfc-literal' END AS match_mode,
      text AS result_text FROM regions WHERE region_id%5<>0),
    j AS (SELECT g.target_id, r.region_id IS NOT NULL AS found, coalesce(matched AND match_mode='nfc-literal' AND result_text=text, false) AS good
      FROM regions g LEFT JOIN r USING (region_id))
    SELECT target_id, bool_and(found) AS complete, bool_and(good) AS all_matched, count(*) FILTER (good) AS matched_regions FROM j GROUP BY 1""",
    "regions",
)
def completeness(t):
    results = t.regions.filter("region_id % 5 <> 0").select(
        "region_id", F.col("needs_ocr_fallback").alias("matched"),
        F.when(F.col("rotation_deg") == 90, "fuzzy").otherwise("nfc-literal").alias("match_mode"),
        F.col("text").alias("expected_text"),
    )
    return consensus.region_completeness(t.regions.select("target_id", "region_id", "text"), results)


@CONSENSUS.query(
    "p12_region_selection",
    """WITH st AS (SELECT target_id, arg_max(status, {'t': ts, 's': status}) AS status FROM stage_log WHERE stage='view' GROUP BY 1)
    SELECT r.target_id, region_id FROM regions r JOIN st USING (target_id) WHERE status='pass' AND needs_ocr_fallback""",
    "regions stage_log",
)
def region_selection(t):
    return consensus.selected_regions(t.regions, t.stage_log, "view").select("target_id", "region_id")


@CONSENSUS.query(
    "a61_batch_report",
    """SELECT target_id, count(*) AS detections, count(*) FILTER (status='fail') AS conflicting_regions, count(*) FILTER (stage='view') AS reused,
    count(*) FILTER (status='pending') AS errors, bool_and(status<>'pending') AS passed FROM stage_log GROUP BY 1""",
    "stage_log",
)
def batch_report(t):
    rows = t.stage_log.select(
        "target_id", (F.col("status") == "fail").alias("conflict"), (F.col("stage") == "view").alias("reused"),
        F.when(F.col("status") == "pending", "error").otherwise("ok").alias("status"),
    )
    return consensus.target_reports(rows)


@CONSENSUS.query(
    "r04_reusable_reports",
    """WITH w AS (SELECT user_id AS target_id, max(k) AS img, count(*) FILTER (event_type='view') AS regions FROM events_k GROUP BY 1),
    p AS (SELECT DISTINCT user_id AS target_id, k AS img FROM events_k WHERE event_type='click')
    SELECT target_id FROM w WHERE NOT (regions>0 AND EXISTS (SELECT 1 FROM p WHERE p.target_id=w.target_id AND p.img=w.img))""",
    "events_k",
)
def reports_to_do(t):
    wanted = t.events_k.groupBy(F.col("user_id").alias("target_id")).agg(
        F.max("k").alias("image"), F.count(F.when(F.col("event_type") == "view", 1)).alias("regions")
    )
    reports = t.events_k.filter("event_type = 'click'").select(
        F.col("user_id").alias("target_id"), F.col("k").alias("image"), F.lit("completed").alias("status"), F.lit(0).alias("errors")
    )
    return consensus.reusable_reports(wanted, reports, ["image"])[1]


_POS = "CASE WHEN {v}<=1536 THEN [0] ELSE list_distinct(list_concat(range(0, {v}-1536+1, 1344), [{v}-1536])) END"


@CONSENSUS.query(
    "f12_tile_origins",
    f"SELECT doc_id, list_aggregate(list_sort({_POS.format(v='n_chars')}), 'string_agg', ',') AS origins FROM documents",
)
def tile_origins(t):
    origins = F.array_sort(boxes.tile_origins(F.col("n_chars"), 1536, 192))
    return t.documents.select("doc_id", F.array_join(F.transform(origins, lambda v: v.cast("string")), ",").alias("origins"))


@CONSENSUS.query(
    "f13_variant_plan",
    f"""WITH i AS (SELECT p_partkey AS image_id, 500+p_partkey*13%3000 AS w, 300+p_partkey*7%2500 AS h, p_partkey%3=0 AS alpha FROM part),
    g AS (SELECT *, {_POS.format(v='w')} AS xs, {_POS.format(v='h')} AS ys, CASE WHEN alpha THEN ['white','black'] ELSE ['opaque'] END AS bg,
      (greatest(w,h)>1536)::INT AS ov FROM i),
    n AS (SELECT *, len(bg)*(len(xs)*len(ys)+ov)*4 AS total FROM g),
    p AS (SELECT image_id, total, unnest(bg) AS b, x, y, w, h, ov FROM n, unnest(xs) a(x), unnest(ys) c(y) WHERE total<=40),
    tiles AS (SELECT image_id, total, b||':tile_x'||x||'_y'||y||'_w'||(least(w,x+1536)-x)||'_h'||(least(h,y+1536)-y) AS nm FROM p
      UNION ALL SELECT image_id, total, unnest(bg)||':overview' FROM n WHERE ov=1 AND total<=40)
    SELECT image_id, nm||':color:r'||r AS variant_id, total, NULL AS error FROM tiles, (VALUES (0),(90),(180),(270)) v(r)
    UNION ALL SELECT image_id, NULL, total, 'too_many_variants' FROM n WHERE total>40""",
)
def variant_plan(t):
    p = F.col("p_partkey")
    images = t.part.select(
        p.alias("image_id"), (p * 13 % 3000 + 500).alias("width"), (p * 7 % 2500 + 300).alias("height"), (p % 3 == 0).alias("has_alpha")
    )
    return consensus.variant_plan(images, 1536, 192, [0, 90, 180, 270], ["color"], max_variants=40)


@CONSENSUS.query(
    "f14_inverse_rotation",
    """SELECT seq, round(CASE rotation_deg WHEN 90 THEN y0 WHEN 180 THEN 500-x0 WHEN 270 THEN 500-y0 ELSE x0 END + 7.0::DOUBLE, 3) AS px,
    round(CASE rotation_deg WHEN 90 THEN 600-x0 WHEN 180 THEN 600-y0 WHEN 270 THEN x0 ELSE y0 END + 9.0::DOUBLE, 3) AS py FROM readings""",
    "readings",
)
def inverse_rotation(t):
    point = F.array(F.array(F.col("x0").cast("double"), F.col("y0").cast("double")))
    back = boxes.unrotate(point, F.col("rotation_deg"), 500, 600, 7.0, 9.0)
    return t.readings.select("seq", back[0][0].alias("px"), back[0][1].alias("py"))


@CONSENSUS.query(
    "f15_polygon_box",
    """SELECT seq, greatest(0, floor(x0-0.5::DOUBLE))::BIGINT AS x0, greatest(0, floor(y0-0.5::DOUBLE))::BIGINT AS y0, least(420, ceil(x1+0.25::DOUBLE))::BIGINT AS x1,
    least(420, ceil(y1+0.25::DOUBLE))::BIGINT AS y1, (x0-0.5+x1+0.25)/2 AS cx, (y0-0.5+y1+0.25)/2 AS cy, (x1-x0+0.75)::DOUBLE AS width, (y1-y0+0.75)::DOUBLE AS height FROM readings""",
    "readings",
)
def polygon_box(t):
    left, top = F.col("x0") - 0.5, F.col("y0") - 0.5
    right, bottom = F.col("x1") + 0.25, F.col("y1") + 0.25
    points = F.array(F.array(left, top), F.array(right, top), F.array(right, bottom), F.array(left, bottom))
    limit = F.lit(420)
    return t.readings.select(
        "seq", boxes.polygon_box(points, limit, limit).alias("b"), boxes.reading_geometry(points).alias("g")
    ).select("seq", "b.*", "g.*")
