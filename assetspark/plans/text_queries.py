"""Scalar text and identifier functions over the given tables."""

from pyspark.sql import functions as F

from ..functions import ids, text
from ..operators import selection
from .adapters_sql import agreement_sql, letters_sql
from .registry import Registry

TEXT = Registry()

_CLAMP_SQL = (
    "CASE WHEN v IS NULL OR isnan(v) OR isinf(v) THEN 0.0 ELSE least(1.0, greatest(0.0, v)) END"
)


@TEXT.query(
    "f01_confidence_clamp",
    f"""SELECT event_id, {_CLAMP_SQL} AS confidence FROM (
    SELECT event_id, TRY_CAST(CASE WHEN k%5=0 THEN 'bad' WHEN k%5=1 THEN 'NaN'
      WHEN k%5=2 THEN (value-20)::VARCHAR ELSE (value/30)::VARCHAR END AS DOUBLE) AS v FROM events_k)""",
    "events_k",
)
def clamp(t):
    k = F.col("k") % 5
    raw = (
        F.when(k == 0, "bad")
        .when(k == 1, "NaN")
        .when(k == 2, (F.col("value") - 20).cast("string"))
        .otherwise((F.col("value") / 30).cast("string"))
    )
    return t.events_k.select("event_id", text.clamp_confidence(raw).alias("confidence"))


@TEXT.query(
    "f02_script_letters",
    f"SELECT doc_id, {letters_sql('text', 'LATIN')} AS latin, {letters_sql('text', 'CYRILLIC')} AS cyrillic FROM documents",
)
def script_letters(t):
    composed = t.documents.select("doc_id", text.nfc(F.col("text")).alias("nfc"))
    return composed.select("doc_id", text.script_letters(F.col("nfc")).alias("s")).select(
        "doc_id", "s.latin", "s.cyrillic"
    )


@TEXT.query(
    "f03_script_label",
    """SELECT conv_id, turn, CASE WHEN regexp_matches(text, '[A-Za-zÀ-ÖØ-öø-ɏ]') THEN 'latin' ELSE 'other' END AS script
    FROM conversations""",
)
def script_label(t):
    return t.conversations.select("conv_id", "turn", text.script_label(F.col("text")).alias("script"))


@TEXT.query(
    "f04_agreement_text",
    f"SELECT doc_id, {agreement_sql('nfc_normalize(text)')} AS agreement FROM documents",
)
def agreement(t):
    return t.documents.select("doc_id", text.agreement_text(F.col("text")).alias("agreement"))


@TEXT.query(
    "f05_literal_text",
    """SELECT page_id, nfc_normalize(replace(replace(crlf, chr(13)||chr(10), chr(10)), chr(13), chr(10))) AS literal
    FROM (SELECT page_id, replace(html, '</p>', '</p>'||chr(13)||chr(10)) AS crlf FROM pages)""",
)
def literal(t):
    crlf = F.replace(F.col("html"), F.lit("</p>"), F.lit("</p>\r\n"))
    return t.pages.select("page_id", text.literal_text(crlf).alias("literal"))


@TEXT.query(
    "f06_canonical_digest",
    """SELECT o_orderkey, sha256('{"customer":'||o_custkey||',"priority":"'||o_orderpriority||'","status":"'||o_orderstatus||'"}') AS digest
    FROM orders""",
)
def canonical_digest(t):
    return t.orders.select(
        "o_orderkey",
        ids.canonical_digest(
            status=F.col("o_orderstatus"), customer=F.col("o_custkey"), priority=F.col("o_orderpriority")
        ).alias("digest"),
    )


@TEXT.query(
    "f07_asset_ids_and_cache_key",
    """SELECT doc_id, 'tex_'||substr(sha256(text),1,20) AS asset_id,
    'src_'||substr(sha256(source||chr(0)||'{"lang":"'||lang||'"}'),1,20) AS source_id,
    sha256('{"engine_signature":"'||source||'","pixel_hash":"'||sha256(text)||'","preprocess_digest":"'||lang
      ||'","preprocess_schema":1,"result_schema":1}') AS cache_key FROM documents""",
)
def asset_ids(t):
    pixel = F.sha2("text", 256)
    return t.documents.select(
        "doc_id",
        ids.asset_id(pixel).alias("asset_id"),
        ids.source_id(F.col("source"), ids.canonical_json(lang=F.col("lang"))).alias("source_id"),
        ids.cache_key(pixel, F.col("source"), F.col("lang")).alias("cache_key"),
    )


@TEXT.query(
    "f08_safe_component",
    """WITH a AS (SELECT page_id, url, regexp_replace(url, '[ .]+$', '') AS t FROM pages),
    b AS (SELECT *, CASE WHEN length(e)<=16 AND NOT regexp_matches(e,'[<>:"/\\\\|?*]') THEN e ELSE '' END AS suffix
      FROM (SELECT *, regexp_extract(t, '^.*[^./\\\\][^/\\\\]*?(\\.[^./\\\\]+)$', 1) AS e FROM a)),
    c AS (SELECT *, trim(regexp_replace(regexp_replace(substr(t,1,length(t)-length(suffix)),'[<>:"/\\\\|?*]','_','g'),'\\s+',' ','g'),' .') AS s FROM b),
    d AS (SELECT *, CASE WHEN s='' THEN 'asset' ELSE s END AS stem FROM c)
    SELECT page_id, CASE WHEN stem||suffix<>url OR length(stem||suffix)>40
      THEN substr(stem,1,greatest(1,30-length(suffix)))||'__'||substr(sha256(page_id::VARCHAR),1,8)||suffix
      ELSE stem||suffix END AS component FROM d""",
)
def safe_component(t):
    return t.pages.select(
        "page_id",
        ids.sanitize_component(F.col("url"), F.col("page_id").cast("string"), 40).alias("component"),
    )


@TEXT.query(
    "f09_safe_names",
    """SELECT path_id, regexp_replace(replace(trim(bundle_key,'/'),'/','@'),'[^0-9A-Za-z._@-]','_','g') AS bundle_file,
    replace(bundle_key,'/','@')||'__'||texture||'.png' AS png FROM texture_names""",
    "texture_names",
)
def safe_names(t):
    return t.texture_names.select(
        "path_id",
        ids.safe_bundle_name(F.col("bundle_key")).alias("bundle_file"),
        ids.png_name(F.col("bundle_key"), F.col("texture")).alias("png"),
    )


@TEXT.query(
    "f11_short_text",
    """SELECT doc_id, CASE WHEN length(c)<=220 THEN c ELSE substr(c,1,219)||'…' END AS short
    FROM (SELECT doc_id, trim(regexp_replace(text,'\\s+',' ','g')) AS c FROM documents)""",
)
def short_text(t):
    return t.documents.select("doc_id", text.short_text(F.col("text")).alias("short"))


_LOW = "lower(texture)"


@TEXT.query(
    "p01_asset_type",
    """SELECT path_id, CASE WHEN asset_type IN ('item','map') THEN asset_type
    WHEN lower(bundle_key) LIKE '%/items/%' OR lower(bundle_key) LIKE '%/usable_items/%' THEN 'item'
    WHEN map IS NOT NULL AND map<>'' THEN 'map' ELSE 'unknown' END AS inferred FROM texture_names""",
    "texture_names",
)
def asset_type(t):
    return t.texture_names.select(
        "path_id",
        selection.asset_type(F.col("asset_type"), F.col("bundle_key"), F.col("map")).alias("inferred"),
    )


@TEXT.query(
    "p02_groups",
    """SELECT path_id, concat_ws('|', grp, CASE WHEN map IS NOT NULL AND map IS DISTINCT FROM grp THEN map END,
    CASE WHEN category IS NOT NULL AND category IS DISTINCT FROM grp AND category IS DISTINCT FROM map THEN category END) AS groups
    FROM (SELECT *, CASE WHEN path_id%6=0 THEN category END AS grp FROM texture_names)""",
    "texture_names",
)
def asset_groups(t):
    explicit = F.when((F.col("path_id") % 6 == 0) & F.col("category").isNotNull(), F.array("category"))
    return t.texture_names.select(
        "path_id",
        F.concat_ws("|", selection.groups(explicit, F.col("map"), F.col("category"))).alias("groups"),
    )


@TEXT.query(
    "p03_metadata_names",
    """WITH m AS (SELECT *, path_id%3 AS k, CASE WHEN path_id%3=2 AND path_id%2=0 THEN NULL ELSE bundle_key END AS key,
      CASE WHEN path_id%4=1 THEN map END AS scene FROM texture_names),
    n AS (SELECT path_id, CASE WHEN k=0 THEN bundle_key WHEN k=1 THEN bundle_key END AS bundle_key, CASE WHEN path_id%5=0 THEN category ELSE texture END AS texture_name,
      CASE WHEN asset_type IN ('item','map') THEN asset_type WHEN lower(bundle_key) LIKE '%/items/%' OR lower(bundle_key) LIKE '%/usable_items/%' THEN 'item'
        WHEN map IS NOT NULL AND map<>'' THEN 'map' ELSE 'unknown' END AS asset_type,
      concat_ws('|', CASE WHEN path_id%6=0 THEN 'g' END, CASE WHEN path_id%4=0 THEN map END, category) AS groups FROM m)
    SELECT * FROM n""",
    "texture_names",
)
def metadata_names(t):
    """Records that name their bundle, texture, type and scene in different fields."""
    p = F.col("path_id")
    fields = {
        "bundle_key": F.when(p % 3 == 0, F.col("bundle_key")), "key": F.when(p % 3 == 1, F.col("bundle_key")), "source": F.when(p % 3 == 2, F.col("bundle_key")),
        "texture_name": F.when(p % 5 == 0, F.coalesce("category", F.lit("\0"))), "texture": F.col("texture"),
        "asset_type": F.when(p % 2 == 0, F.col("asset_type")), "assetType": F.when(p % 2 == 1, F.col("asset_type")),
        "scene": F.when(p % 4 == 1, F.col("map")), "scene_path": F.when(p % 4 > 1, F.col("map")), "map": F.when(p % 4 == 0, F.col("map")),
        "groups": F.when(p % 6 == 0, F.lit('["g", " "]')), "category": F.col("category"),
    }
    entries = F.array_compact(F.array(*[F.when(v.isNotNull(), F.struct(F.lit(k).alias("key"), v.alias("value"))) for k, v in fields.items()]))
    named = t.texture_names.select("path_id", selection.normalized_metadata(F.map_from_entries(entries)).alias("m"))
    name = F.nullif(F.col("m.texture_name"), F.lit("\0"))
    return named.select("path_id", "m.bundle_key", name.alias("texture_name"), "m.asset_type", F.concat_ws("|", "m.groups").alias("groups"))


def _sql_list(values):
    return ", ".join(f"'{v}'" for v in values)


_SKIP_SQL = f"""SELECT path_id, CASE WHEN last IS NULL OR last IN ({_sql_list(selection.COLOR_TOKENS)}) THEN NULL
    WHEN last IN ({_sql_list(selection.NON_COLOR_TOKENS)}) THEN 'non_color_suffix:'||last
    WHEN len(list_filter(tok[-2:], lambda v: v IN ({_sql_list(selection.NON_COLOR_TOKENS)})))>0 THEN 'non_color_token' END AS skip_reason
    FROM (SELECT path_id, tok, tok[-1] AS last FROM (
      SELECT path_id, list_filter(regexp_split_to_array(lower(texture), '[^a-z0-9]+'), lambda v: v<>'') AS tok FROM texture_names))"""


@TEXT.query("p04_color_filter", _SKIP_SQL, "texture_names")
def color_filter(t):
    return t.texture_names.select(
        "path_id", selection.color_skip_reason(F.col("texture")).alias("skip_reason")
    )


@TEXT.query(
    "p05_bundle_asset_type",
    """SELECT path_id, CASE WHEN asset_type IN ('item','map') THEN asset_type
    WHEN lower(bundle_key) LIKE '%/items/%' OR lower(bundle_key) LIKE '%/usable_items/%' THEN 'item' ELSE 'map' END AS bundle_type
    FROM texture_names""",
    "texture_names",
)
def bundle_type(t):
    return t.texture_names.select(
        "path_id",
        selection.bundle_asset_type(F.col("asset_type"), F.col("bundle_key")).alias("bundle_type"),
    )


_ROLE_SQL = f"""CASE WHEN suffix({_LOW},'_n') OR contains({_LOW},'nrm') OR contains({_LOW},'normal') THEN 'normal'
    WHEN suffix({_LOW},'_g') OR contains({_LOW},'gloss') OR contains({_LOW},'smooth') THEN 'gloss'
    WHEN suffix({_LOW},'_d') OR contains({_LOW},'diff') OR contains({_LOW},'albedo') OR contains({_LOW},'basecolor') THEN 'diffuse'
    ELSE 'other' END"""


@TEXT.query("p06_texture_role", f"SELECT path_id, {_ROLE_SQL} AS role FROM texture_names", "texture_names")
def role(t):
    return t.texture_names.select("path_id", selection.texture_role(F.col("texture")).alias("role"))


@TEXT.query(
    "p07_texture_family",
    f"SELECT path_id, regexp_replace({_LOW}, '(_lod0_diff|_lod0_nrm|_lod0_gloss|_diff|_nrm|_gloss|_d|_n|_g)$', '') AS family FROM texture_names",
    "texture_names",
)
def family(t):
    return t.texture_names.select("path_id", selection.texture_family(F.col("texture")).alias("family"))


@TEXT.query(
    "p08_ignored_diffuse",
    f"SELECT path_id, ({_ROLE_SQL})='diffuse' AND (contains({_LOW},'red') OR contains({_LOW},'plate')) AS ignored FROM texture_names",
    "texture_names",
)
def ignored(t):
    return t.texture_names.select(
        "path_id", selection.ignored_diffuse(F.col("texture"), ["Red", "plate"]).alias("ignored")
    )


@TEXT.query(
    "p09_name_search",
    "SELECT texture AS name, bundle_key FROM texture_names WHERE contains(lower(texture), 'widget')",
    "texture_names",
)
def name_search(t):
    index = t.texture_names.select(F.col("texture").alias("name"), "bundle_key")
    return selection.search_names(index, "WIDGET")


@TEXT.query(
    "s06_image_field",
    """SELECT record_id, coalesce(CASE WHEN NOT regexp_matches(a,'^\\s*$') THEN a END,
    CASE WHEN NOT regexp_matches(category,'^\\s*$') THEN category END) AS image
    FROM (SELECT *, CASE WHEN record_id%3=0 THEN '  ' ELSE path END AS a FROM manifest)""",
    "manifest",
)
def image_field(t):
    blanked = F.when(F.col("record_id") % 3 == 0, F.lit("  ")).otherwise(F.col("path"))
    return t.manifest.select(
        "record_id", selection.first_non_blank(blanked, F.col("category")).alias("image")
    )
