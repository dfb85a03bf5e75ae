"""DuckDB twins of the adapters, used only to check results."""

from __future__ import annotations

from .adapters import (
    DETECTION_WORDS,
    READING_WORDS,
    REVIEW_DECISIONS,
    SLOT_PROPERTIES,
    STAGE_STATUS,
    TEXTURE_ENDINGS,
)
from ..functions.text import letter_class


def pick(values: list[str], index: str) -> str:
    quoted = ", ".join(f"'{v}'" for v in values)
    return f"([{quoted}])[({index})::BIGINT + 1]"


def channel(k: int) -> str:
    return (
        f"CAST(floor(least(255.0, greatest(0.0, (embedding[4*x+{k + 1}]::DOUBLE + 1) * 127.5))"
        " + 0.5) AS BIGINT)"
    )


_FLAGS = """
  ((x+y)%5=0 OR x<4) AS editable, NOT ((x+y)%5=0 OR x<4) AS protected,
  (x=15 AND NOT ((x+y)%5=0 OR x<4)) AS seam_guard,
  (x+y)%10=0 AS old_text, (x+y)%15=0 AS new_text, ((x-8)*(x-8)+(y-8)*(y-8) <= 49) AS covered
"""

_NOISE = "((x*7+y*3)%5-2)"


def _effect(ch: str) -> str:
    neutral = f"(CASE WHEN old_text THEN 128 ELSE {ch} END)"
    edited = f"(CASE WHEN new_text THEN least(255,greatest(0,{neutral}+40)) ELSE {neutral} END)"
    extra = f"(CASE WHEN new_text THEN {_NOISE} ELSE 0 END)"
    return f"""
      {ch} AS is_{ch}, {neutral} AS in_{ch}, {edited} AS ie_{ch},
      least(255,greatest(0,{ch}+{_NOISE})) AS as_{ch},
      least(255,greatest(0,{neutral}+{_NOISE})) AS an_{ch},
      least(255,greatest(0,{edited}+{_NOISE}+{extra})) AS ae_{ch}"""


# name -> (adapter names it reads, SELECT)
CTES: dict[str, tuple[list[str], str]] = {
    "events_k": ([], "SELECT *, CAST(json_extract(props,'$.k') AS INT) AS k FROM events"),
    "detections": (
        ["events_k"],
        f"""SELECT event_id//3 AS asset_id, event_id AS seq, {pick(DETECTION_WORDS, 'k%7')} AS text,
        least(1.0, round(value/100,6)) AS confidence, event_type AS engine, 'v'||(k%4) AS variant
        FROM events_k""",
    ),
    "readings": (
        ["events_k"],
        f"""SELECT user_id AS image_id, event_id AS seq, {pick(READING_WORDS, 'k%7')} AS text,
        CASE WHEN k%7=4 THEN 'other' ELSE 'latin' END AS script,
        least(1.0, round(value/50,6)) AS confidence, event_type AS engine,
        event_type||'-m'||(k%2) AS model_signature, 'v'||(k%3) AS variant, 90*(k%4) AS rotation_deg,
        (event_id*37)%400 AS x0, (event_id*91)%400 AS y0,
        (event_id*37)%400+60+k%30 AS x1, (event_id*91)%400+40+k%10 AS y1 FROM events_k""",
    ),
    "region_calls": (
        ["events_k"],
        f"""SELECT event_id//8 AS call_id, event_id//16 AS region_id, event_id AS seq,
        {pick(READING_WORDS, 'k%7')} AS text, least(1.0, round(value/50,6)) AS confidence,
        event_type AS engine, event_type||'-m'||(k%2) AS model_signature,
        'v'||((event_id//8)%2) AS variant, CAST((event_id%8)*50+k%20 AS DOUBLE) AS cx,
        CAST(((event_id%8)//3)*18+k%5 AS DOUBLE) AS cy, CAST(10+k%6 AS DOUBLE) AS height
        FROM events_k""",
    ),
    "review_log": (
        ["events_k"],
        f"""SELECT user_id AS asset_id, {pick(REVIEW_DECISIONS, 'k%5')} AS decision,
        event_type AS reviewer, ts AS reviewed_at FROM events_k""",
    ),
    "stage_log": (
        ["events_k"],
        f"""SELECT user_id AS target_id, event_type AS stage, {pick(STAGE_STATUS, 'k%3')} AS status,
        sha256(event_id::VARCHAR) AS evidence_sha256, ts FROM events_k""",
    ),
    "regions": (
        ["events_k"],
        f"""SELECT user_id AS target_id, event_id AS region_id, {pick(READING_WORDS, 'k%7')} AS text,
        k%3+1 AS occurrences, CASE WHEN k%5<3 THEN k%5=0 END AS ocr_required,
        k%2=0 AS needs_ocr_fallback, {pick(['front', 'back', 'side'], 'k%3')} AS face,
        90*(k%4) AS rotation_deg, event_id%300 AS x0, event_id*7%300 AS y0,
        event_id%300+20+k%120 AS x1, event_id*7%300+20+k%90 AS y1
        FROM events_k""",
    ),
    "texture_names": (
        [],
        f"""SELECT p_partkey AS path_id, replace(p_name,' ','_')||{pick(TEXTURE_ENDINGS, 'p_partkey%7')} AS texture,
        {pick(['assets/items/', 'assets/usable_items/', 'assets/maps/', 'other/'], 'p_partkey%4')}
          ||lower(replace(p_brand,'#','_')) AS bundle_key,
        CASE WHEN p_partkey%11=0 THEN 'item' WHEN p_partkey%13=0 THEN 'map' END AS asset_type,
        CASE WHEN p_partkey%3=0 THEN lower(p_type) END AS category,
        CASE WHEN p_partkey%5=0 THEN 'scene'||(p_partkey%9) END AS map FROM part""",
    ),
    "manifest": (
        [],
        """SELECT doc_id AS record_id, CASE WHEN doc_id%17<>0 THEN 'img/'||substr(md5(text),1,8)||'.png' END AS path,
        source AS category, lang AS asset_group, sha256(text) AS pixel_sha256, text FROM documents""",
    ),
    "slots": (
        [],
        f"""SELECT 'mat/'||(l_orderkey%50) AS bundle_key, l_orderkey AS material_path_id,
        {pick(SLOT_PROPERTIES, 'l_linenumber-1')} AS property,
        'tex/'||(l_suppkey%20) AS texture_bundle_key, l_partkey%500+1 AS path_id,
        1.0::DOUBLE+l_discount AS scale_u, 1.0::DOUBLE AS scale_v, l_tax AS offset_u, 0.0::DOUBLE AS offset_v FROM lineitem""",
    ),
    "raw_slots": (
        ["slots"],
        """SELECT *, 'cab-'||(material_path_id%4) AS assets_file, path_id%3 AS file_id,
        CASE WHEN path_id%3>0 THEN 'archive:/'||texture_bundle_key END AS external_assets_file FROM slots""",
    ),
    "raw_materials": (
        [],
        """SELECT 'mat/'||(abs(k)%50) AS bundle_key, 'cab-'||(abs(k)%4) AS assets_file, k AS material_path_id
        FROM (SELECT o_orderkey AS k FROM orders UNION ALL SELECT -c_custkey FROM customer)""",
    ),
    "targets": (
        [],
        """SELECT DISTINCT 'tex/'||(p_partkey%20) AS texture_bundle_key, p_partkey%500+1 AS path_id,
        't'||(p_partkey%500+1)||'tex/'||(p_partkey%20) AS target_id FROM part WHERE p_size<=5""",
    ),
    "deps": (
        [],
        """SELECT DISTINCT 'mat/'||(o_custkey%50) AS bundle_key, 'tex/'||(c_nationkey%20) AS depends_on
        FROM orders JOIN customer ON o_custkey=c_custkey""",
    ),
    "texels": (
        [],
        f"""SELECT vec_id//16 AS texture_id, x, vec_id%16 AS y, {channel(0)} AS r, {channel(1)} AS g,
        {channel(2)} AS b, {channel(3)} AS a FROM embeddings, range(16) t(x)""",
    ),
    "odd_texels": (
        ["texels"],
        """SELECT picture AS texture_id, (place%105)%width AS x, (place%105)//width AS y, r, g, b, a FROM (
        SELECT place, place//105 AS picture, [15,5,1,35][((place//105)%4)::BIGINT+1]::BIGINT AS width, r, g, b, a FROM (
        SELECT texture_id*256+y*16+x AS place, r, g, b, a FROM texels))""",
    ),
    "edited_texels": (
        ["texels"],
        "SELECT texture_id,x,y,CASE WHEN (x+y)%5=0 THEN (r+17)%256 ELSE r END AS r,g,b,a FROM texels",
    ),
    "flagged_texels": (["texels"], f"SELECT *, {_FLAGS} FROM texels"),
    "mask_texels": (["texels"], f"SELECT texture_id,x,y, {_FLAGS} FROM texels"),
    "effect_levels": (
        ["flagged_texels"],
        f"""SELECT *, {_effect('g')}, {_effect('a')} FROM (
        SELECT *, 0 AS level FROM flagged_texels UNION ALL BY NAME
        SELECT texture_id, x//2 AS x, y//2 AS y, round_even(avg(r),0)::BIGINT AS r, round_even(avg(g),0)::BIGINT AS g, round_even(avg(b),0)::BIGINT AS b,
          round_even(avg(a),0)::BIGINT AS a, bool_or(editable) AS editable, bool_or(protected) AS protected, bool_or(seam_guard) AS seam_guard,
          bool_or(old_text) AS old_text, bool_or(new_text) AS new_text, bool_or(covered) AS covered, 1 AS level FROM flagged_texels GROUP BY 1,2,3)""",
    ),
    "mesh_triangles": (
        [],
        """SELECT l_suppkey%10 AS mesh, l_linenumber%3 AS submesh, l_partkey AS a,
        100000+l_suppkey AS b, 200000+l_orderkey%5000 AS c FROM lineitem""",
    ),
    "uv_triangles": (
        [],
        """SELECT p_partkey%8 AS mesh, p_partkey AS tri,
        (p_partkey*37%1000)::DOUBLE/1000-0.2::DOUBLE AS ua, (p_partkey*91%1000)::DOUBLE/1000-0.1::DOUBLE AS va,
        (p_partkey*37%1000)::DOUBLE/1000-0.2::DOUBLE+(p_partkey%7+2)::DOUBLE/50 AS ub,
        (p_partkey*91%1000)::DOUBLE/1000-0.1::DOUBLE+(p_partkey%3)::DOUBLE/50 AS vb,
        (p_partkey*37%1000)::DOUBLE/1000-0.2::DOUBLE+(p_partkey%5)::DOUBLE/50 AS uc,
        (p_partkey*91%1000)::DOUBLE/1000-0.1::DOUBLE+(p_partkey%4+2)::DOUBLE/50 AS vc FROM part""",
    ),
    "vertices": (
        [],
        """SELECT p_partkey%8 AS mesh, p_partkey AS vid,
        (p_partkey*13%400)::DOUBLE/8+(p_partkey%3-1)*1e-7::DOUBLE+CASE WHEN p_partkey%7<3 THEN (p_partkey//400)*60.0::DOUBLE ELSE 0.0::DOUBLE END AS px, (p_partkey*7%20)::DOUBLE/4 AS py,
        (p_partkey%2)::DOUBLE AS pz, (p_partkey*5%16)::DOUBLE/16 AS u, (p_partkey*3%8)::DOUBLE/8 AS v FROM part""",
    ),
    "vertex_triangles": (
        [],
        """SELECT p_partkey%8 AS mesh, (p_partkey//8)%2 AS submesh, p_partkey AS tri,
        p_partkey AS a, p_partkey+8 AS b, p_partkey+24 AS c FROM part""",
    ),
    "intervals": (
        [],
        """SELECT l_suppkey AS grp, l_partkey*10 AS "start", l_partkey*10+CAST(l_quantity AS BIGINT) AS "end" FROM lineitem""",
    ),
    "recorded_artifacts": (
        [],
        """SELECT 'a/'||o_orderkey AS path, 't'||o_custkey AS target_id, sha256(o_orderstatus||o_orderkey) AS sha256 FROM orders""",
    ),
    "current_artifacts": (
        [],
        """SELECT 'a/'||o_orderkey AS path,
        sha256(o_orderstatus||o_orderkey||CASE WHEN o_orderkey%97=0 THEN 'x' ELSE '' END) AS sha256
        FROM orders WHERE o_orderkey%89<>0""",
    ),
}


def agreement_sql(column: str) -> str:
    return f"replace(lower(regexp_replace({column}, '[^\\p{{L}}\\p{{N}}]', '', 'g')), 'ß', 'ss')"


def letters_sql(column: str, word: str) -> str:
    return f"length(regexp_replace(nfc_normalize({column}), '[^{letter_class(word)}]', '', 'g'))"


def with_ctes(names: list[str], body: str) -> str:
    """Prefix ``body`` with the named adapters; a WITH in the body is merged."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in CTES[name][0]:
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    body = body.strip()
    recursive = "RECURSIVE " if body.upper().startswith("WITH RECURSIVE") else ""
    own = body[len("WITH RECURSIVE" if recursive else "WITH"):].strip() if body.upper().startswith("WITH") else None
    heads = [f"{name} AS ({CTES[name][1]})" for name in ordered]
    if own is not None:
        if not heads:
            return body
        return f"WITH {recursive}" + ", ".join(heads) + ", " + own
    return (f"WITH {', '.join(heads)} " if heads else "") + body
