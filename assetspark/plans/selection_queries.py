"""Discovery, dedup, classification, reviews and reports."""

from pyspark.sql import functions as F

from ..functions.arithmetic import div
from ..operators import selection
from .adapters import pick
from .adapters_sql import letters_sql
from .adapters_sql import pick as pick_sql
from .registry import Registry
from .text_queries import _SKIP_SQL

SELECTION = Registry()

_TYPE = """CASE WHEN asset_type IN ('item','map') THEN asset_type
    WHEN lower(bundle_key) LIKE '%/items/%' OR lower(bundle_key) LIKE '%/usable_items/%' THEN 'item'
    WHEN map IS NOT NULL AND map<>'' THEN 'map' ELSE 'unknown' END"""


def _plan_sources(t):
    return t.texture_names.select(
        "path_id",
        selection.asset_type(F.col("asset_type"), F.col("bundle_key"), F.col("map")).alias("asset_type"),
        selection.color_skip_reason(F.col("texture")).alias("skip_reason"),
    )


@SELECTION.query(
    "a01_plan_counts",
    f"""WITH s AS (SELECT n.path_id, {_TYPE} AS ty, k.skip_reason FROM texture_names n JOIN ({_SKIP_SQL}) k USING (path_id))
    SELECT 'total' AS counter, 'total_sources' AS name, count(*) AS n FROM s
    UNION ALL SELECT 'total','color_candidates', count(*) FROM s WHERE skip_reason IS NULL
    UNION ALL SELECT 'total','skipped_non_color', count(skip_reason) FROM s
    UNION ALL SELECT 'asset_type', ty, count(*) FROM s GROUP BY ty
    UNION ALL SELECT 'skip_reason', skip_reason, count(*) FROM s WHERE skip_reason IS NOT NULL GROUP BY skip_reason""",
    "texture_names",
)
def plan_counts(t):
    return selection.plan_counts(_plan_sources(t))


@SELECTION.query(
    "a02_manifest_dedup",
    """SELECT path, category, asset_group, count(*) AS copies FROM manifest WHERE path IS NOT NULL
    GROUP BY path, category, asset_group""",
    "manifest",
)
def manifest_dedup(t):
    rows = t.manifest.filter("path is not null")
    return selection.drop_exact_copies(rows, "path", ["category", "asset_group"]).drop("record_key")


_SOURCES = """SELECT *, 'src'||lpad(record_id::VARCHAR, 9, '0') AS source_id FROM manifest"""


def _sources(t):
    return t.manifest.withColumn(
        "source_id", F.concat(F.lit("src"), F.lpad(F.col("record_id").cast("string"), 9, "0"))
    )


@SELECTION.query(
    "a03_pixel_groups",
    f"""SELECT 'tex_'||substr(pixel_sha256,1,20) AS asset_id, pixel_sha256,
    arg_min(path, source_id) AS representative_path, arg_min(source_id, source_id) AS representative_id,
    count(*) AS reference_count FROM ({_SOURCES}) WHERE path IS NOT NULL GROUP BY pixel_sha256""",
    "manifest",
)
def pixel_groups(t):
    return selection.pixel_groups(_sources(t).filter("path is not null").select("path", "source_id", "pixel_sha256"))


@SELECTION.query(
    "s07_missing_inputs",
    """SELECT record_id, path, CASE WHEN path IS NULL THEN 'manifest_image_field_missing' ELSE 'image_missing' END AS reason
    FROM manifest WHERE path IS NULL OR path NOT IN (SELECT path FROM manifest WHERE record_id%4<>0 AND path IS NOT NULL)""",
    "manifest",
)
def missing_inputs(t):
    listing = t.manifest.filter("record_id % 4 <> 0 and path is not null").select("path")
    _, missing = selection.split_missing(t.manifest.select("record_id", "path"), listing)
    return missing


@SELECTION.query(
    "j30_manifest_union_folder",
    """WITH m AS (SELECT DISTINCT path FROM manifest WHERE path IS NOT NULL AND record_id%2=0),
    f AS (SELECT DISTINCT upper(path) AS path FROM manifest WHERE path IS NOT NULL AND record_id%3=0)
    SELECT path, 'manifest' AS origin FROM m UNION ALL
    SELECT path, 'folder' FROM f WHERE lower(path) NOT IN (SELECT lower(path) FROM m)""",
    "manifest",
)
def manifest_union_folder(t):
    rows = t.manifest.filter("path is not null")
    return selection.union_listing(
        rows.filter("record_id % 2 = 0"),
        rows.filter("record_id % 3 = 0").select(F.upper("path").alias("path")),
    )


@SELECTION.query(
    "k04_limit_on_pictures",
    f"""WITH s AS ({_SOURCES}), o AS (SELECT *, row_number() OVER (ORDER BY path, source_id) AS pos FROM s WHERE path IS NOT NULL),
    f AS (SELECT pixel_sha256, min(pos) AS first FROM o GROUP BY 1),
    l AS (SELECT max(first) AS last FROM (SELECT first FROM f ORDER BY first LIMIT 100)),
    c AS (SELECT min(pos) AS cut FROM o, l WHERE pos > last)
    SELECT path, source_id, pixel_sha256 FROM o, c WHERE pos < cut""",
    "manifest",
)
def limit_on_pictures(t):
    rows = _sources(t).filter("path is not null").select("path", "source_id", "pixel_sha256")
    return selection.limit_groups(rows, 100)


_CLASSIFY = f"""l AS (SELECT *, {letters_sql('text', 'LATIN')} AS latin, {letters_sql('text', 'CYRILLIC')} AS cyrillic FROM detections),
    e AS (SELECT asset_id,
      max(struct_pack(c := confidence, n := latin+cyrillic, t := text)) FILTER (latin+cyrillic>0) AS best,
      bool_or(latin>0) AS hl, bool_or(cyrillic>0) AS hc,
      count(DISTINCT engine) FILTER (latin+cyrillic>0) AS te, count(DISTINCT engine) AS ae,
      bool_or(trim(text)='' AND confidence>=0.15) AS det, max(confidence) AS top FROM l GROUP BY asset_id),
    ag AS (SELECT DISTINCT x.asset_id FROM l x JOIN l y ON x.asset_id=y.asset_id AND x.seq<y.seq AND x.engine<>y.engine
      AND x.latin>0 AND y.latin>0 AND x.confidence>=0.45 AND y.confidence>=0.45 AND lower(x.text)=lower(y.text)),
    c AS (SELECT e.asset_id, CASE WHEN best IS NULL AND det THEN 'needs_review' WHEN best IS NULL THEN 'rejected'
      WHEN best.c>=0.8 AND best.n>=3 THEN 'confirmed' WHEN ag.asset_id IS NOT NULL THEN 'confirmed'
      WHEN best.c>=0.45 AND best.n>=2 THEN 'probable' ELSE 'needs_review' END AS tier,
      CASE WHEN best IS NULL AND det THEN top ELSE coalesce(best.c, 0.0) END AS score,
      concat_ws('|', CASE WHEN hl THEN 'latin' END, CASE WHEN hc THEN 'cyrillic' END) AS scripts,
      coalesce(best.n, 0) AS target_letter_count, CASE WHEN best IS NULL THEN ae ELSE te END AS engine_count,
      CASE WHEN best IS NULL AND det THEN 'detector_only' WHEN best IS NULL THEN 'no_latin_or_cyrillic'
      WHEN best.c>=0.8 AND best.n>=3 THEN 'target_script|primary_high' WHEN ag.asset_id IS NOT NULL THEN 'target_script|engine_agreement'
      WHEN best.c>=0.45 AND best.n>=2 THEN 'target_script|primary_medium' ELSE 'target_script|weak_target_evidence' END AS reason_codes
      FROM e LEFT JOIN ag ON e.asset_id=ag.asset_id)"""


@SELECTION.query("a04_tier_classification", f"WITH {_CLASSIFY} SELECT * FROM c", "detections")
def tier_classification(t):
    return selection.classify(t.detections)


# near-equal words, so that the similarity of unequal texts decides
NEAR_WORDS = ["WARNING", "WARNINGS", "STOP", "STOPSIGN", "BEERS", "BEER", "12"]


@SELECTION.query(
    "j17_engine_agreement",
    f"""WITH e AS (SELECT user_id AS asset_id, event_id AS seq, event_type AS engine, lower({pick_sql(NEAR_WORDS, 'k%7')}) AS w
      FROM events_k WHERE value/100>=0.45 AND k%7<>6),
    p AS (SELECT DISTINCT x.asset_id, x.w AS a, y.w AS b FROM e x JOIN e y
      ON x.asset_id=y.asset_id AND x.seq<y.seq AND x.engine<>y.engine)
    SELECT DISTINCT asset_id FROM p WHERE a=b
      OR (a IN ('warning','warnings') AND b IN ('warning','warnings')) OR (a IN ('beer','beers') AND b IN ('beer','beers'))""",
    "events_k",
)
def engine_agreement(t):
    rows = t.events_k.select(
        F.col("user_id").alias("asset_id"),
        F.col("event_id").alias("seq"),
        F.col("event_type").alias("engine"),
        F.least(F.lit(1.0), F.round(F.col("value") / 100, 6)).alias("confidence"),
        pick(NEAR_WORDS, F.col("k") % 7).alias("text"),
    )
    return selection.agreeing_assets(selection.with_letters(rows))


@SELECTION.query(
    "w03_compact_detections",
    f"""WITH l AS (SELECT *, {letters_sql('text', 'LATIN')} AS n FROM detections),
    d AS (SELECT *, row_number() OVER (PARTITION BY asset_id, engine, lower(text) ORDER BY (n=0), -confidence, variant, seq) AS rn FROM l)
    SELECT asset_id, row_number() OVER (PARTITION BY asset_id ORDER BY (n=0), -confidence, engine, lower(text), variant, seq) AS position,
    seq, text, engine, confidence, variant FROM d WHERE rn=1 QUALIFY position<=200""",
    "detections",
)
def compact(t):
    return selection.compact_detections(t.detections)


@SELECTION.query(
    "a05_processing_status",
    """SELECT asset_id, count(*) FILTER (ok) AS variant_calls, count(error) AS errors,
    arg_min(error, call_no) FILTER (error IS NOT NULL) AS error,
    CASE WHEN count(*) FILTER (ok)=0 OR count(error)>0 THEN 'error' ELSE 'ok' END AS status,
    CASE WHEN count(*) FILTER (ok)=0 THEN 'error' END AS forced_tier
    FROM (SELECT event_id//3 AS asset_id, event_id AS call_no, k%7<>0 AS ok, CASE WHEN k%7=0 THEN 'e'||k END AS error FROM events_k)
    GROUP BY asset_id""",
    "events_k",
)
def status(t):
    failed = F.col("k") % 7 == 0
    calls = t.events_k.select(
        div(F.col("event_id"), 3).alias("asset_id"),
        F.col("event_id").alias("call_no"),
        (~failed).alias("ok"),
        F.when(failed, F.concat(F.lit("e"), "k")).alias("error"),
    )
    return selection.processing_status(calls)


_REVIEWS = """rv AS (SELECT * FROM (SELECT asset_id, arg_max(decision, reviewed_at) AS decision,
    arg_max(reviewer, reviewed_at) AS reviewer, max(reviewed_at) AS reviewed_at FROM review_log GROUP BY asset_id) WHERE decision<>'clear')"""
_RESULTS = f"""{_CLASSIFY}, {_REVIEWS},
    res AS (SELECT c.*, decision, reviewer, coalesce(nullif(decision,''), tier, 'unknown') AS effective_tier,
      CASE WHEN c.asset_id%10=0 THEN 'error' ELSE 'ok' END AS status FROM c LEFT JOIN rv USING (asset_id))"""


def _results(t):
    return selection.overlay_reviews(
        selection.classify(t.detections), selection.current_reviews(t.review_log)
    ).withColumn("status", F.when(F.col("asset_id") % 10 == 0, "error").otherwise("ok"))


@SELECTION.query(
    "r02_review_upsert",
    f"WITH {_REVIEWS} SELECT * FROM rv",
    "review_log",
)
def review_upsert(t):
    return selection.current_reviews(t.review_log)


@SELECTION.query("j15_review_overlay", f"WITH {_RESULTS} SELECT * FROM res", "detections review_log")
def review_overlay(t):
    return _results(t)


@SELECTION.query(
    "p10_effective_tier",
    f"WITH {_RESULTS} SELECT effective_tier, count(*) AS n FROM res GROUP BY 1",
    "detections review_log",
)
def effective_tiers(t):
    return _results(t).groupBy("effective_tier").agg(F.count("*").alias("n"))


@SELECTION.query(
    "p11_review_candidates",
    f"WITH {_RESULTS} SELECT asset_id, effective_tier, status FROM res WHERE effective_tier IN ('confirmed','probable','needs_review') OR status='error'",
    "detections review_log",
)
def review_candidates(t):
    return selection.review_queue(_results(t)).select("asset_id", "effective_tier", "status")


@SELECTION.query(
    "k01_review_queue",
    f"""WITH {_RESULTS} SELECT asset_id, effective_tier, score FROM res
    WHERE effective_tier IN ('confirmed','probable','needs_review') OR status='error' ORDER BY effective_tier, score DESC, asset_id LIMIT 50""",
    "detections review_log",
)
def queue(t):
    return selection.review_queue(_results(t).select("asset_id", "effective_tier", "score", "status"), 50).drop("status")


@SELECTION.query(
    "k02_report_order",
    f"""WITH {_RESULTS} SELECT asset_id, effective_tier, score,
    CASE effective_tier WHEN 'confirmed' THEN 0 WHEN 'probable' THEN 1 WHEN 'needs_review' THEN 2 WHEN 'rejected' THEN 3 ELSE 9 END AS rank
    FROM res WHERE effective_tier IN ('confirmed','probable','needs_review') OR status='error'""",
    "detections review_log",
)
def report_order(t):
    return selection.report_rows(_results(t)).select("asset_id", "effective_tier", "score", "rank")


@SELECTION.query(
    "a06_run_summary",
    f"""WITH {_RESULTS}, r AS (SELECT *, asset_id%3+1 AS refs FROM res)
    SELECT 'total' AS counter, 'unique_textures' AS name, count(*) AS n FROM r
    UNION ALL SELECT 'total','source_references', sum(refs)::BIGINT FROM r
    UNION ALL SELECT 'total','candidate_textures', count(*) FILTER (effective_tier IN ('confirmed','probable','needs_review')) FROM r
    UNION ALL SELECT 'tier', effective_tier, count(*) FROM r GROUP BY 2
    UNION ALL SELECT 'processing', status, count(*) FROM r GROUP BY 2""",
    "detections review_log",
)
def summary(t):
    return selection.run_summary(_results(t).withColumn("reference_count", F.col("asset_id") % 3 + 1))


@SELECTION.query(
    "a58_cache_status",
    """WITH c AS (SELECT asset_id, arg_max(decision, {'t': reviewed_at, 'd': decision, 'r': reviewer}) AS decision FROM review_log GROUP BY 1),
    u AS (SELECT o_custkey AS run_id, max(CASE WHEN o_orderkey%3<>0 THEN o_orderdate END) AS finished_at, count(*) AS n FROM orders GROUP BY 1),
    l AS (SELECT * FROM u WHERE finished_at IS NOT NULL ORDER BY finished_at DESC, run_id DESC LIMIT 1)
    SELECT (SELECT count(DISTINCT sha256(text)) FROM documents) AS cached_results, (SELECT count(*) FROM c WHERE decision<>'clear') AS reviewed_assets,
    (SELECT count(*) FROM review_log) AS review_rows, (SELECT max(reviewed_at) FROM review_log) AS latest_review,
    run_id AS latest_run, 'orders='||n AS latest_summary, finished_at AS latest_run_at FROM l""",
    "review_log",
)
def cache_status(t):
    results = t.documents.select(F.sha2("text", 256).alias("cache_key")).distinct()
    runs = t.orders.groupBy(F.col("o_custkey").alias("run_id")).agg(
        F.max(F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate"))).alias("finished_at"), F.concat(F.lit("orders="), F.count("*")).alias("summary")
    )
    return selection.cache_status(results, t.review_log, runs)


@SELECTION.query(
    "j16_cache_lookup",
    """WITH w AS (SELECT doc_id, sha256(text) AS cache_key FROM documents),
    c AS (SELECT DISTINCT sha256(text) AS cache_key, CASE WHEN length(text)%4=0 THEN '{broken' ELSE '{"n":'||length(text)||'}' END AS j
      FROM documents WHERE length(text)%2=0)
    SELECT doc_id, w.cache_key, CASE WHEN j NOT LIKE '{broken%' THEN j END AS cached_json,
    CASE WHEN j IS NULL OR j LIKE '{broken%' THEN 'miss' ELSE 'hit' END AS state FROM w LEFT JOIN c USING (cache_key)""",
)
def cache_lookup(t):
    docs = t.documents.select("doc_id", F.sha2("text", 256).alias("cache_key"), F.length("text").alias("n"))
    stored = F.when(F.col("n") % 4 == 0, F.lit("{broken")).otherwise(
        F.concat(F.lit('{"n":'), "n", F.lit("}"))
    )
    cache = docs.filter("n % 2 = 0").select("cache_key", stored.alias("result_json")).distinct()
    return selection.cache_state(docs.select("doc_id", "cache_key"), cache)


@SELECTION.query(
    "r01_cache_upsert",
    """SELECT cache_key, arg_max(doc_id, doc_id) AS doc_id, max(doc_id) AS created_at
    FROM (SELECT sha256(text) AS cache_key, doc_id FROM documents WHERE doc_id%9<>0) GROUP BY 1""",
)
def cache_upsert(t):
    ok = t.documents.filter("doc_id % 9 <> 0").select(
        F.sha2("text", 256).alias("cache_key"), "doc_id", F.col("doc_id").alias("created_at")
    )
    return selection.latest_by(ok, ["cache_key"], "created_at", ["doc_id"])


_INDEX = "SELECT path_id AS position, texture AS name, bundle_key FROM texture_names"


@SELECTION.query(
    "j28_name_lookup",
    f"""WITH i AS ({_INDEX}) SELECT lower(name) AS low, bundle_key, min(position) AS position FROM i
    WHERE lower(name) IN (SELECT lower(name) FROM i WHERE position%5=0) GROUP BY 1,2""",
    "texture_names",
)
def name_lookup(t):
    index = t.texture_names.select(F.col("path_id").alias("position"), F.col("texture").alias("name"), "bundle_key")
    return selection.lookup_names(index, index.filter("position % 5 = 0").select(F.upper("name").alias("name")))


_REFRESH = """WITH o AS (SELECT DISTINCT texture AS name, bundle_key FROM texture_names WHERE path_id%2=0),
    s AS (SELECT DISTINCT texture||'2' AS name, bundle_key FROM texture_names WHERE path_id%5=0),
    k AS (SELECT DISTINCT bundle_key FROM texture_names WHERE path_id%5=0)
    SELECT name, bundle_key FROM o WHERE bundle_key NOT IN (SELECT bundle_key FROM k) UNION SELECT name, bundle_key FROM s"""


@SELECTION.query("s17_index_refresh", _REFRESH, "texture_names")
def index_refresh(t):
    names = t.texture_names
    old = names.filter("path_id % 2 = 0").select(F.col("texture").alias("name"), "bundle_key").distinct()
    scanned = names.filter("path_id % 5 = 0").select(F.concat("texture", F.lit("2")).alias("name"), "bundle_key")
    return selection.refresh_index(old, scanned, scanned)


_REFS = """SELECT 'tex_'||substr(pixel_sha256,1,20) AS asset_id, record_id, path, pixel_sha256,
    CASE WHEN record_id%3=0 THEN 'map' WHEN record_id%5=0 THEN 'item' ELSE 'unknown' END AS asset_type,
    CASE WHEN record_id%7<>0 THEN category ELSE ' ' END AS grp FROM manifest WHERE path IS NOT NULL"""


def _references(t):
    r = F.col("record_id")
    return t.manifest.filter("path is not null").select(
        F.concat(F.lit("tex_"), F.substring("pixel_sha256", 1, 20)).alias("asset_id"),
        "record_id",
        F.concat(F.col("path"), F.lit("#"), r).alias("path"),
        F.col("pixel_sha256").alias("sha256"),
        F.when(r % 3 == 0, "map").when(r % 5 == 0, "item").otherwise("unknown").alias("asset_type"),
        F.when(r % 7 != 0, F.col("category")).otherwise(F.lit(" ")).alias("group"),
    )


@SELECTION.query(
    "s15_catalog_routing",
    f"""WITH r AS (SELECT asset_id, asset_type, CASE WHEN trim(grp)<>'' THEN grp END AS g FROM ({_REFS})),
    p AS (SELECT asset_id, asset_type, count(DISTINCT g) AS n, min(g) AS lo FROM r GROUP BY 1,2),
    a AS (SELECT asset_id, count(DISTINCT g) AS n, min(g) AS lo, bool_or(asset_type<>'unknown') AS known FROM r GROUP BY 1)
    SELECT asset_id, CASE asset_type WHEN 'map' THEN 'maps' ELSE 'items' END AS root,
      CASE WHEN n=1 THEN lo WHEN n>1 THEN '_shared' WHEN asset_type='map' THEN '_unassigned' ELSE '_uncategorized' END AS folder
      FROM p WHERE asset_type<>'unknown'
    UNION ALL SELECT asset_id, 'unknown', CASE WHEN n=1 THEN lo ELSE '_unassigned' END FROM a WHERE NOT known""",
    "manifest",
)
def catalog_routing(t):
    return selection.catalog_destinations(_references(t))


@SELECTION.query(
    "s15_verified_source",
    f"""WITH r AS (SELECT asset_id, path||'#'||record_id AS path, pixel_sha256 AS sha256, record_id FROM ({_REFS}))
    SELECT asset_id, arg_min(path, lower(path)) AS path, arg_min(sha256, lower(path)) AS sha256 FROM r
    WHERE record_id%4<>0 AND record_id%6<>0 GROUP BY asset_id""",
    "manifest",
)
def verified_source(t):
    refs = _references(t)
    current = refs.filter("record_id % 4 <> 0").select(
        "path", F.when(F.col("record_id") % 6 == 0, F.lit("changed")).otherwise(F.col("sha256")).alias("sha256")
    )
    return selection.verified_source(refs, current)


@SELECTION.query(
    "s16_materialize_actions",
    """SELECT o_orderkey, CASE WHEN o_orderkey%5=0 THEN 'copy' WHEN o_orderkey%5=1 THEN 'keep'
    WHEN o_orderkey%5=2 THEN 'repair' WHEN o_orderkey%5=3 THEN CASE WHEN o_orderkey%2=0 THEN 'repair' ELSE 'skip' END
    ELSE 'skip' END AS action FROM orders""",
)
def materialize_actions(t):
    k = F.col("o_orderkey")
    base = t.orders.select("o_orderkey", F.concat(F.lit("x/"), k).alias("target"), F.sha2(k.cast("string"), 256).alias("sha256"))
    plan = base.withColumn("asset_id", k.cast("string"))
    existing = base.filter(k % 5 != 0).select(
        "target",
        F.when(k % 5 != 3, F.when(k % 5 == 4, F.lit("other")).otherwise(F.col("sha256"))).alias("file_sha256"),
        F.when((k % 5 == 1) | ((k % 5 == 3) & (k % 2 == 0)), k.cast("string"))
        .when(k % 5 == 3, F.lit("?"))
        .alias("sidecar_asset_id"),
    )
    return selection.materialize_actions(plan, existing).select("o_orderkey", "action")


@SELECTION.query(
    "p24_preferred_source",
    """SELECT p_partkey, CASE WHEN p_partkey%3=0 THEN 'edited/'||p_partkey ELSE 'raw/'||p_partkey END AS source
    FROM part WHERE p_partkey%3=0 OR p_partkey%2=0""",
)
def preferred_source(t):
    p = F.col("p_partkey")

    def files(folder, chosen):
        return t.part.filter(chosen).select(p.alias("name"), F.concat(F.lit(folder), p).alias("file"))

    wanted = t.part.select(p.alias("name"))
    chosen = selection.prefer_edited(wanted, files("edited/", "p_partkey % 3 = 0"), files("raw/", "p_partkey % 2 = 0"))
    return chosen.select(F.col("name").alias("p_partkey"), "source")
