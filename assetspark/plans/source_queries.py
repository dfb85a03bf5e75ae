"""Readers, sinks, the recognizer and incremental tables over the given tables."""

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.arithmetic import div
from ..functions.ids import rgba_pixel_hash
from ..operators import recognizer, selection
from ..session import shared_folder
from ..sources import images, manifests, sinks
from ..streaming.incremental import BundleIndex
from .adapters_sql import agreement_sql, letters_sql
from .registry import Registry
from .selection_queries import _CLASSIFY, _references

SOURCES = Registry()


@SOURCES.query(
    "s01_content_hashes",
    """WITH h AS (SELECT doc_id, sha256(coalesce(text,'')) AS sha256, strlen(coalesce(text,''))::BIGINT AS size FROM documents)
    SELECT doc_id, sha256, size, doc_id = min(doc_id) OVER (PARTITION BY sha256) AS first FROM h""",
)
def content_hashes(t):
    return images.hashed_contents(t.documents.withColumn("text", F.coalesce("text", F.lit(""))), "doc_id", "text")


_SUFFIXES = [".png", ".PNG", ".jpeg", ".dds", "", ".TIF", ".json", "/.png"]


@SOURCES.query(
    "s04_file_listing",
    f"""SELECT path_id, bundle_key||'/'||texture||({_SUFFIXES!r})[(path_id%8)::BIGINT+1] AS path FROM texture_names WHERE path_id%8 IN (0,1,2,5)""",
    "texture_names",
)
def file_listing(t):
    ending = F.get(F.array(*[F.lit(s) for s in _SUFFIXES]), F.col("path_id") % 8)
    paths = t.texture_names.select("path_id", F.concat("bundle_key", F.lit("/"), "texture", ending).alias("path"))
    return images.by_extension(paths, "path")


@SOURCES.query(
    "s03_pixel_fingerprint",
    """SELECT texture_id, 16 AS width, count(DISTINCT y) AS height, sha256(encode('RGBA:16x'||count(DISTINCT y))||'\\x00'::BLOB||
    unhex(string_agg(printf('%02x%02x%02x%02x', r, g, b, a), '' ORDER BY y, x))) AS pixel_sha256 FROM texels GROUP BY 1""",
    "texels",
)
def pixel_fingerprint(t):
    packed = images.pack_pictures(t.texels, 16)
    return packed.select("texture_id", "width", "height", rgba_pixel_hash("width", "height", "channels", "data").alias("pixel_sha256"))


@SOURCES.query("s02_texel_roundtrip", "SELECT texture_id, x, y, r, g, b, a FROM texels", "texels")
def texel_roundtrip(t):
    """Pictures packed to bytes and exploded again give the same texels."""
    return images.explode_texels(images.pack_pictures(t.texels, 16))


@SOURCES.query(
    "s05_manifest_records",
    """SELECT o_orderkey AS source, CASE WHEN o_orderkey%5<>4 THEN 'img/'||o_orderkey END AS image, CASE WHEN o_orderkey%5=4 THEN 'unsupported_manifest' END AS error FROM orders WHERE o_orderkey%5 NOT IN (2,3)
    UNION ALL SELECT o_orderkey, 'img/'||o_custkey, NULL FROM orders WHERE o_orderkey%5 IN (0,1)
    UNION ALL SELECT o_orderkey, CASE WHEN o_orderkey%5 IN (2,3) THEN 'img/'||o_orderkey END, CASE WHEN o_orderkey%5 NOT IN (2,3) THEN 'unsupported_manifest' END FROM orders WHERE o_orderkey%5 IN (0,2,3)""",
)
def manifest_records(t):
    k = F.col("o_orderkey")
    one = F.to_json(F.struct(F.concat(F.lit("img/"), k).alias("image"), F.col("o_orderstatus").alias("kind")))
    two = F.to_json(F.struct(F.concat(F.lit("img/"), F.col("o_custkey")).alias("image")))
    text = (
        F.when(k % 5 == 0, F.concat(F.lit("["), one, F.lit(","), two, F.lit("]")))
        .when(k % 5 == 1, F.concat(F.lit('{"entries":['), one, F.lit(","), two, F.lit("]}")))
        .when(k % 5 == 4, F.lit("[1, 2"))
        .otherwise(one)
    )
    docs = t.orders.select(k.alias("source"), text.alias("value"))
    # single objects are rows of a JSONL file, lists and wrapped lists whole files; the rest is wrong as either
    files = manifests.manifest_records(docs.filter("source % 5 not in (2, 3)"), "value")
    rows = manifests.manifest_records(docs.filter("source % 5 in (0, 2, 3)"), "value", lines=True)
    return files.unionByName(rows).select("source", F.col("record")["image"].alias("image"), "error")


@SOURCES.query("s08_catalog_dependencies", "SELECT bundle_key, depends_on FROM deps", "deps")
def catalog_dependencies(t):
    """Catalog objects with one entry per dependency, parsed back to rows."""
    entry = F.to_json(F.create_map("bundle_key", F.struct(F.array("depends_on").alias("Dependencies"))))
    return manifests.catalog_dependencies(t.deps.select(entry.alias("value")), "value")


@SOURCES.query(
    "s09_profile_violations",
    """WITH b AS (SELECT CASE WHEN p_partkey%101=0 THEN '../b'||p_partkey ELSE 'b'||(p_partkey-p_partkey%50//49) END AS key FROM part WHERE p_partkey%3<>0),
    t AS (SELECT 't'||(p_partkey-(p_partkey%60)//59) AS id, CASE WHEN p_partkey%70=0 THEN '' ELSE p_name||(p_partkey//3) END AS texture, CASE WHEN p_partkey%4<>0 THEN 'b'||(p_partkey//3) END AS bundle_key,
      CASE WHEN p_partkey%90=0 THEN 'drop' WHEN p_partkey%2=0 THEN 'preserve' ELSE 'localize' END AS action FROM part)
    SELECT 'unsafe_key' AS kind, key AS name FROM b WHERE key LIKE '../%' UNION ALL SELECT 'texture_missing', id FROM t WHERE texture='' UNION ALL SELECT 'unknown_action', id FROM t WHERE action='drop'
    UNION ALL SELECT 'duplicate_bundle', key FROM b GROUP BY key HAVING count(*)>1 UNION ALL SELECT 'duplicate_target', id FROM t GROUP BY id HAVING count(*)>1
    UNION ALL SELECT 'duplicate_texture', bundle_key||'::'||texture FROM t WHERE bundle_key IS NOT NULL GROUP BY bundle_key, texture HAVING count(*)>1
    UNION ALL SELECT 'unknown_bundle', id FROM t WHERE bundle_key IS NOT NULL AND bundle_key NOT IN (SELECT key FROM b)""",
)
def profile_violations(t):
    p = F.col("p_partkey")
    bundles = t.part.filter(p % 3 != 0).select(
        F.when(p % 101 == 0, F.concat(F.lit("../b"), p)).otherwise(F.concat(F.lit("b"), p - div(p % 50, 49))).alias("key")
    )
    targets = t.part.select(
        F.concat(F.lit("t"), p - div(p % 60, 59)).alias("id"),
        F.when(p % 70 == 0, "").otherwise(F.concat("p_name", div(p, 3))).alias("texture"),
        F.when(p % 4 != 0, F.concat(F.lit("b"), div(p, 3))).alias("bundle_key"),
        F.when(p % 90 == 0, "drop").when(p % 2 == 0, "preserve").otherwise("localize").alias("action"),
    )
    return manifests.profile_violations(bundles, targets)


@SOURCES.query(
    "s10_inventory_sections",
    """SELECT o_orderkey, o_orderkey%5 AS schema_version, CASE WHEN o_orderkey%2=0 THEN 1 ELSE 0 END AS records, CASE WHEN o_orderkey%3=0 THEN 1 ELSE 0 END AS materials, 0 AS renderers,
    CASE WHEN o_orderkey%5 NOT IN (1,2,3) THEN 'unsupported_schema' END AS error FROM orders""",
)
def inventory_sections(t):
    k = F.col("o_orderkey")
    item = F.array(F.create_map(F.lit("texture"), F.col("o_orderpriority")))
    text = F.to_json(F.struct(
        (k % 5).alias("schema_version"), F.when(k % 2 == 0, item).alias("records"), F.when(k % 3 == 0, item).alias("materials")
    ))
    out = manifests.inventory_sections(t.orders.select(k, text.alias("value")), "value")
    return out.select("o_orderkey", "schema_version", *[F.size(c).alias(c) for c in ("records", "materials", "renderers")], "error")


def _meshes(t):
    """Five vectors are one flat array of 64 vertices; a strip of triangles runs over them.

    Every vector keeps its place in the array, also where an earlier one is missing; the last mesh may have fewer vectors.
    """
    parts = t.embeddings.groupBy(div(F.col("vec_id"), 5).alias("mesh")).agg(
        F.array_sort(F.collect_list(F.struct("vec_id", F.col("embedding").cast("array<double>").alias("e")))).alias("parts")
    )
    numbers = F.sequence(F.lit(0), F.lit(63))

    def vector(slot: Column) -> Column:
        held = F.get(F.filter("parts", lambda part: part["vec_id"] % 5 == slot), F.lit(0))
        return F.transform(numbers, lambda i: F.get(held["e"], i))

    last = F.element_at("parts", -1)["vec_id"] % 5
    flat = F.flatten(F.transform(F.sequence(F.lit(0).cast("long"), last), vector))
    corners = F.sequence(F.lit(0).cast("long"), F.lit(3 * 62 - 1).cast("long"))
    return parts.select(
        "mesh", (F.col("mesh") % 3).alias("submesh"), flat.alias("vertices"),
        F.transform(corners, lambda i: div(i, 3) + i % 3).alias("triangles"),
    )


@SOURCES.query(
    "s18_mesh_tables",
    """WITH f AS (SELECT vec_id//5 AS mesh, (vec_id%5)*64+i AS i, embedding[i+1]::DOUBLE AS e FROM embeddings, range(64) t(i))
    SELECT mesh, i//5 AS vid, max(e) FILTER (i%5=0) AS x, max(e) FILTER (i%5=1) AS y, max(e) FILTER (i%5=2) AS z, max(e) FILTER (i%5=3) AS u, max(e) FILTER (i%5=4) AS v FROM f GROUP BY 1,2""",
)
def mesh_tables(t):
    vertices, _ = manifests.mesh_tables(_meshes(t))
    return vertices


@SOURCES.query(
    "s18_mesh_triangles",
    "SELECT mesh, mesh%3 AS submesh, i AS tri, i AS a, i+1 AS b, i+2 AS c FROM (SELECT DISTINCT vec_id//5 AS mesh FROM embeddings), range(62) t(i)",
)
def mesh_triangles(t):
    _, triangles = manifests.mesh_tables(_meshes(t))
    return triangles


@SOURCES.query(
    "s14_latest_run",
    """SELECT user_id%20 AS collection, arg_max(event_id, ts) AS run_id, max(ts) AS finished_at, count(*) AS runs FROM events GROUP BY 1""",
)
def latest_run(t):
    runs = t.events.select((F.col("user_id") % 20).alias("collection"), F.col("event_id").alias("run_id"), F.col("ts").alias("finished_at"))
    return sinks.latest_run(runs)


def _stored_results(t):
    """Results written by the sink; the folder they lie in."""
    rows = selection.classify(t.detections).select(
        F.col("asset_id").cast("string").alias("asset_id"), F.concat(F.lit("img/"), "asset_id").alias("representative_source"),
        F.lit("ok").alias("status"), "tier", "score", F.nullif(F.col("scripts"), F.lit("")).alias("text"),
    )
    folder = f"{shared_folder(t.spark)}/assetspark-{uuid.uuid4().hex}"
    sinks.write_results(rows, folder)
    return folder


_STORED = "st AS (SELECT asset_id::VARCHAR AS asset_id, 'img/'||asset_id AS representative_source, 'ok' AS status, tier, score, nullif(scripts,'') AS text FROM c)"


@SOURCES.query(
    "s12_result_rows",
    f"WITH {_CLASSIFY}, {_STORED} SELECT row_number() OVER (ORDER BY asset_id) AS position, asset_id, tier, text IS NULL AS no_text FROM st",
    "detections",
)
def result_rows(t):
    """The sorted lines of the written files, in the order of files and lines; null fields are written."""
    lines = sinks.lines_in_order(t.spark, _stored_results(t))
    fields = F.from_json("value", "asset_id string, tier string", {"mode": "FAILFAST"})
    return lines.select("position", fields.alias("r"), F.contains("value", F.lit('"text":null')).alias("no_text")).select("position", "r.*", "no_text")


@SOURCES.query("s11_result_load", f"WITH {_CLASSIFY}, {_STORED} SELECT * FROM st", "detections")
def result_load(t):
    """Written results read back with the fail-fast reader."""
    return manifests.load_results(t.spark, _stored_results(t))


@SOURCES.query(
    "s14_run_record",
    """WITH p AS (SELECT CASE WHEN asset_type IN ('item','map') THEN asset_type ELSE 'unknown' END AS name, count(*) AS n FROM texture_names GROUP BY 1),
    u AS (SELECT 'asset_type/'||name AS name, n FROM p UNION ALL SELECT 'total/total_sources', sum(n)::BIGINT FROM p UNION ALL SELECT 'total/color_candidates', sum(n)::BIGINT FROM p
      UNION ALL SELECT 'total/skipped_non_color', 0)
    SELECT 'run-1' AS run_id, 1 AS schema_version, true AS finished, ['part'] AS inputs, '{"limit":null}' AS config, name, n FROM u""",
    "texture_names",
)
def run_record(t):
    kind = F.when(F.col("asset_type").isin("item", "map"), F.col("asset_type")).otherwise("unknown")
    plan = selection.plan_counts(t.texture_names.select(kind.alias("asset_type"), F.lit(None).cast("string").alias("skip_reason")))
    started = F.lit("2024-01-01 00:00:00").cast("timestamp")
    record = sinks.run_record("run-1", started, started, ["part"], {"limit": None}, plan, plan.limit(0))
    folder = f"{shared_folder(t.spark)}/assetspark-{uuid.uuid4().hex}"
    sinks.append_run(record, folder)
    back = t.spark.read.parquet(folder)
    return back.select("run_id", "schema_version", F.col("finished_at").isNotNull().alias("finished"), "inputs", "config", F.explode("plan").alias("name", "n"))


@SOURCES.query(
    "s13_summary_rows",
    """WITH r AS (SELECT 'tex_'||substr(pixel_sha256,1,20) AS asset_id, CASE WHEN record_id%3=0 THEN 'map' WHEN record_id%5=0 THEN 'item' ELSE 'unknown' END AS ty,
      CASE WHEN record_id%7<>0 THEN category ELSE ' ' END AS g, record_id, asset_group FROM manifest WHERE path IS NOT NULL)
    SELECT asset_id, coalesce(string_agg(CASE WHEN record_id%4<>0 THEN asset_group END, ' | ' ORDER BY record_id), '') AS ocr_text, count(*) AS reference_count, string_agg(DISTINCT ty, '|' ORDER BY ty) AS asset_types,
    string_agg(DISTINCT g, '|' ORDER BY g) AS groups FROM r GROUP BY 1""",
    "manifest",
)
def summary_rows(t):
    refs = _references(t)
    texts = t.manifest.filter("path is not null and record_id % 4 <> 0").select(
        F.concat(F.lit("tex_"), F.substring("pixel_sha256", 1, 20)).alias("asset_id"), F.col("record_id").alias("position"), F.col("asset_group").alias("text")
    )
    return sinks.summary_rows(refs.select("asset_id").distinct(), texts, refs)


def _words_at(payload: bytes, variant: str) -> tuple[str, int]:
    """The first, middle or last word of the whole text."""
    words, number = payload.decode().split(" "), int(variant[1:])
    return words[(len(words) - 1) * number // 2], number


def _primary(payload: bytes, variant: str) -> list[dict]:
    word, number = _words_at(payload, variant)
    if len(word) % 13 == 0:
        raise ValueError("unreadable")
    return [{"text": word, "confidence": (len(word) * 17 + number * 29) % 100 / 100}]


def _fallback(payload: bytes, variant: str) -> list[dict]:
    word, number = _words_at(payload, variant)
    return [{"text": word[::-1] if number == 0 else word, "confidence": (len(word) * 23 + number * 7 + 41) % 100 / 100}]


_BEST = "max(CASE WHEN {on} THEN {{'c': c, 'n': n, 'w': w}} END) OVER (PARTITION BY asset_id ORDER BY {by} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_BEFORE = "coalesce(bool_or({on}) OVER (PARTITION BY asset_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false)"


@SOURCES.query(
    "u0_batch_recognizer",
    f"""WITH t AS (SELECT doc_id AS asset_id, string_split(coalesce(text, ''), ' ') AS ws FROM documents),
    r AS (SELECT asset_id, k, ws[((len(ws)-1)*k)//2+1] AS word FROM t, (SELECT unnest([0,1,2]) AS k)),
    p0 AS (SELECT asset_id, k, word AS w, (length(word)*17+k*29)%100/100.0::DOUBLE AS c, length(word)%13=0 AS bad, {letters_sql('word', 'LATIN')}+{letters_sql('word', 'CYRILLIC')} AS n FROM r),
    p1 AS (SELECT *, {_BEST.format(on='NOT bad AND n>0', by='k')} AS best FROM p0),
    p2 AS (SELECT *, coalesce(best.c>=0.8 AND best.n>=3, false) AS sure FROM p1),
    p AS (SELECT * FROM (SELECT *, {_BEFORE.format(on='bad OR sure')} AS over FROM p2) WHERE NOT over),
    d AS (SELECT asset_id FROM p GROUP BY 1 HAVING bool_or(sure AND NOT bad)),
    f0 AS (SELECT asset_id, k, CASE WHEN k=0 THEN reverse(word) ELSE word END AS w, (length(word)*23+k*7+41)%100/100.0::DOUBLE AS c,
      {letters_sql('word', 'LATIN')}+{letters_sql('word', 'CYRILLIC')} AS n FROM r WHERE asset_id NOT IN (SELECT asset_id FROM d)),
    f1 AS (SELECT *, n>0 AND c>=0.45 AND EXISTS (SELECT 1 FROM p WHERE p.asset_id=f0.asset_id AND NOT p.bad AND p.n>0 AND p.c>=0.45
      AND {agreement_sql('p.w')}={agreement_sql('f0.w')}) AS same FROM f0),
    b AS (SELECT asset_id, k-10 AS pos, w, c, n, false AS same FROM p WHERE NOT bad UNION ALL SELECT asset_id, k AS pos, w, c, n, same FROM f1),
    b1 AS (SELECT *, {_BEST.format(on='n>0', by='pos')} AS best, bool_or(same) OVER (PARTITION BY asset_id ORDER BY pos) AS agreed FROM b),
    f2 AS (SELECT *, pos AS k, coalesce(best.c>=0.8 AND best.n>=3, false) OR agreed AS sure FROM b1 WHERE pos>=0),
    f AS (SELECT * FROM (SELECT *, {_BEFORE.format(on='sure')} AS over FROM f2) WHERE NOT over),
    m AS (SELECT asset_id, k, 1 AS stage, w, c, n, bad, false AS same FROM p UNION ALL SELECT asset_id, k, 2, w, c, n, false, same FROM f),
    g AS (SELECT asset_id, count(*) FILTER (NOT bad) AS variant_calls, max(CASE WHEN bad THEN 'one/v'||k||': ValueError: unreadable' END) AS error,
      max(CASE WHEN NOT bad AND n>0 THEN {{'c': c, 'n': n, 'w': w}} END) AS best, bool_or(same) AS agreed,
      bool_or(NOT bad AND NOT regexp_matches(w, '[^\\s]') AND c>=0.15) AS blank, max(c) FILTER (NOT bad) AS top FROM m GROUP BY 1)
    SELECT asset_id, CASE WHEN error IS NULL THEN 'ok' ELSE 'error' END AS status, error, variant_calls,
    CASE WHEN best IS NULL THEN CASE WHEN blank THEN 'needs_review' ELSE 'rejected' END WHEN best.c>=0.8 AND best.n>=3 OR agreed THEN 'confirmed'
      WHEN best.c>=0.45 AND best.n>=2 THEN 'probable' ELSE 'needs_review' END AS tier,
    CASE WHEN best IS NULL THEN CASE WHEN blank THEN top ELSE 0 END ELSE best.c END AS score FROM g""",
)
def batch_recognizer(t):
    """Two-stage scan of the whole texts; the plugged-in readers take words of them, equal texts agree."""
    assets = t.documents.select(F.col("doc_id").alias("asset_id"), F.coalesce("text", F.lit("")).cast("binary").alias("payload"))
    exact = selection.Thresholds(agreement_similarity=1.0)
    return recognizer.scan_assets(assets, ("one", _primary), ("two", _fallback), ["v0", "v1", "v2"], exact)


@SOURCES.query(
    "r03_index_refresh_batches",
    """WITH o AS (SELECT DISTINCT texture AS name, bundle_key, 0 AS v FROM texture_names),
    s AS (SELECT DISTINCT texture||'3' AS name, bundle_key, 1 AS v FROM texture_names WHERE path_id%9=0),
    e AS (SELECT DISTINCT CASE WHEN path_id%2=0 THEN texture||'5' END AS name, bundle_key, 2 AS v FROM texture_names WHERE path_id%31=0),
    u AS (SELECT * FROM o UNION ALL SELECT * FROM s UNION ALL SELECT * FROM e), n AS (SELECT bundle_key, max(v) AS v FROM u GROUP BY 1)
    SELECT name, bundle_key FROM u JOIN n USING (bundle_key, v) WHERE name IS NOT NULL""",
    "texture_names",
)
def index_batches(t):
    """A starting index and two batches of scans, the second of them delivered twice and with emptied bundles."""
    names = t.texture_names
    index = BundleIndex(t.spark, f"{shared_folder(t.spark)}/assetspark-{uuid.uuid4().hex}")
    index.start(names.select(F.col("texture").alias("name"), "bundle_key"))
    index.apply(names.filter("path_id % 9 = 0").select(F.concat("texture", F.lit("3")).alias("name"), "bundle_key"), 0)
    second = names.filter("path_id % 31 = 0").select(F.when(F.col("path_id") % 2 == 0, F.concat("texture", F.lit("5"))).alias("name"), "bundle_key")
    for _ in range(2):
        index.apply(second, 1)
    return index.current()


_FINGERPRINT = "sha256(coalesce(length(source)||':'||source,'-')||coalesce(length(lang)||':'||lang,'-')||'64:'||sha256(text))"


@SOURCES.query(
    "r05_background_reuse",
    f"""WITH w AS (SELECT doc_id, {_FINGERPRINT} AS fingerprint FROM documents)
    SELECT doc_id, fingerprint, fingerprint IN (SELECT fingerprint FROM w WHERE doc_id%3=0) AS reused FROM w""",
)
def background_reuse(t):
    work = t.documents.select("doc_id", "source", "lang", F.sha2("text", 256).alias("content"))
    fields = ["source", "lang", "content"]
    cache = selection.reusable_by_fingerprint(work.filter("doc_id % 3 = 0"), t.spark.createDataFrame([], "fingerprint string"), fields)
    return selection.reusable_by_fingerprint(work, cache, fields).select("doc_id", "fingerprint", "reused")


@SOURCES.query(
    "u1_casefold",
    "SELECT doc_id, replace(lower(nfc_normalize(text)),'ß','ss') AS folded FROM documents",
)
def folded(t):
    from ..functions.text import casefold

    return t.documents.select("doc_id", casefold(F.col("text")).alias("folded"))


@SOURCES.query("u2_similarity_pairs")
def similarity_pairs(t):
    """Similarity of each benchmark text with the next one, whole texts."""
    from ..functions.text import agreement_text, similarity

    items = t.benchmark.select("item_id", agreement_text(F.col("text")).alias("key"))
    nxt = items.select((F.col("item_id") - 1).alias("item_id"), F.col("key").alias("next_key"))
    return items.join(nxt, "item_id").select("item_id", F.round(similarity("key", "next_key"), 6).alias("ratio"))
