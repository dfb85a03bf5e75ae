"""Texel analytics queries: changes, masks, mips, projections, selections."""

from pyspark.sql import functions as F

from ..functions import color
from ..functions.arithmetic import div
from ..functions.ids import tree_digest_sql
from ..operators import mips, texels, words
from .adapters import pick
from .registry import Registry

TEXELS = Registry()
SIZE = (16, 16)


def _pairs(t):
    return t.mask_flags(texels.paired(t.texels, t.edited_texels))


_PAIRS = """pr AS (SELECT m.*, t.r AS br, t.g AS bg, t.b AS bb, t.a AS ba, e.r AS ar, e.g AS ag, e.b AS ab, e.a AS aa,
    (t.r<>e.r OR t.g<>e.g OR t.b<>e.b) AS ch FROM mask_texels m JOIN texels t USING (texture_id,x,y) JOIN edited_texels e USING (texture_id,x,y))"""
_NEED = "mask_texels texels edited_texels"


@TEXELS.query(
    "a20_change_measurement",
    f"""WITH {_PAIRS} SELECT texture_id, count(*) AS texels, count(*) FILTER (ch) AS changed_pixels, count(*) FILTER (ba<>aa) AS changed_alpha,
    count(*) FILTER (ch AND NOT editable) AS changed_outside_editable, count(*) FILTER (ch AND protected) AS changed_inside_protected,
    count(*) FILTER (ch AND seam_guard) AS changed_inside_seam_guard FROM pr GROUP BY 1""",
    _NEED,
)
def change_measurement(t):
    return texels.change_measurements(_pairs(t))


@TEXELS.query(
    "a21_mask_relations",
    """SELECT texture_id, count(*) FILTER (old_text AND NOT editable) AS old_text_outside, count(*) FILTER (new_text AND NOT editable) AS new_text_outside,
    count(*) FILTER (editable AND protected) AS editable_protected, count(*) FILTER (seam_guard AND NOT protected) AS seam_unprotected,
    count(*) FILTER (editable) AS editable_pixels FROM mask_texels GROUP BY 1""",
    "mask_texels",
)
def mask_relations(t):
    return texels.mask_violations(t.mask_texels)


@TEXELS.query(
    "a22_projection_invariants",
    f"""WITH {_PAIRS} SELECT texture_id, count(*) FILTER ((x+y)%10<>0 AND (ch OR ba<>aa)) AS outside_changes, count(*) FILTER (ba<>aa) AS alpha_changes FROM pr GROUP BY 1""",
    _NEED,
)
def projection_invariants(t):
    return texels.projection_invariants(_pairs(t), F.when(F.col("old_text"), 255).otherwise(0))


@TEXELS.query(
    "a22_opaque_view",
    f"WITH {_PAIRS} SELECT texture_id, count(*) FILTER (ch) AS rgb_changes, count(*) FILTER (aa<>255) AS nonopaque_pixels FROM pr GROUP BY 1",
    _NEED,
)
def opaque_view(t):
    return texels.opaque_view_check(_pairs(t))


@TEXELS.query(
    "a22_selection_subset",
    """SELECT texture_id, count(*) FILTER (new_text AND NOT editable) AS outside_allowed, count(*) FILTER (editable AND NOT new_text) AS unselected_allowed,
    count(*) FILTER (editable AND NOT new_text)>0 AS reduced FROM mask_texels WHERE new_text OR editable GROUP BY 1""",
    "mask_texels",
)
def selection_subset(t):
    return texels.selection_subset(t.mask("new_text"), t.mask("editable"))


_X01 = "SELECT 'union' AS op, texture_id, x, y FROM mask_texels WHERE old_text OR seam_guard"


@TEXELS.query(
    "x01_mask_algebra",
    f"""{_X01} UNION ALL SELECT 'intersection', texture_id, x, y FROM mask_texels WHERE old_text AND editable
    UNION ALL SELECT 'difference', texture_id, x, y FROM mask_texels WHERE editable AND NOT new_text""",
    "mask_texels",
)
def mask_algebra(t):
    parts = {
        "union": texels.union_masks(t.mask("old_text"), t.mask("seam_guard")),
        "intersection": texels.intersect_masks(t.mask("old_text"), t.mask("editable")),
        "difference": texels.subtract_masks(t.mask("editable"), t.mask("new_text")),
    }
    out = None
    for name, part in parts.items():
        named = part.select(F.lit(name).alias("op"), *texels.KEY)
        out = named if out is None else out.unionByName(named)
    return out


@TEXELS.query(
    "x01_subset_violations",
    "SELECT texture_id, count(*) AS outside FROM mask_texels WHERE new_text AND NOT old_text GROUP BY 1",
    "mask_texels",
)
def subset_violations(t):
    return texels.subset_violations(t.mask("new_text"), t.mask("old_text"))


_D = "dil AS (SELECT DISTINCT texture_id, px AS x, py AS y FROM mask_texels m, range(16) a(px), range(16) b(py) WHERE new_text AND abs(px-m.x)<=2 AND abs(py-m.y)<=2)"


@TEXELS.query("x03_dilation", f"WITH {_D} SELECT * FROM dil", "mask_texels")
def dilation(t):
    return texels.dilate(t.mask("new_text"), 2, *SIZE)


@TEXELS.query(
    "x04_block_expansion",
    """SELECT texture_id, x, y FROM mask_texels WHERE (texture_id, x//4, y//4) IN (SELECT (texture_id, x//4, y//4) FROM mask_texels WHERE seam_guard)""",
    "mask_texels",
)
def block_expansion(t):
    return texels.expand_blocks(t.mask_texels, t.mask("seam_guard"))


@TEXELS.query(
    "a31_mask_projection",
    "SELECT DISTINCT texture_id, x//4 AS x, y//4 AS y FROM mask_texels WHERE seam_guard",
    "mask_texels",
)
def mask_projection(t):
    return texels.shrink_mask(t.mask("seam_guard"), 4)


@TEXELS.query(
    "a29_mask_chain",
    "SELECT DISTINCT texture_id, l AS level, x>>l AS x, y>>l AS y FROM mask_texels, (SELECT l::INT AS l FROM range(5) t(l)) WHERE new_text",
    "mask_texels",
)
def mask_chain(t):
    return mips.mask_chain(t.mask("new_text"), 5, t.texture_sizes)


@TEXELS.query(
    "a32_combined_coverage",
    "SELECT texture_id, count(*) AS covered FROM mask_texels WHERE covered OR new_text OR old_text GROUP BY 1",
    "mask_texels",
)
def combined_coverage(t):
    union = texels.union_masks(t.mask("covered"), t.mask("new_text"), t.mask("old_text"))
    return union.groupBy("texture_id").agg(F.count("*").alias("covered"))


@TEXELS.query(
    "x05_nearest_fill",
    """WITH c AS (SELECT * FROM flagged_texels WHERE covered) SELECT t.texture_id, t.x, t.y,
    arg_min(c.x, ((c.x-t.x)*(c.x-t.x)+(c.y-t.y)*(c.y-t.y))*100000+c.y*100+c.x) AS source_x,
    arg_min(c.y, ((c.x-t.x)*(c.x-t.x)+(c.y-t.y)*(c.y-t.y))*100000+c.y*100+c.x) AS source_y,
    arg_min(c.r, ((c.x-t.x)*(c.x-t.x)+(c.y-t.y)*(c.y-t.y))*100000+c.y*100+c.x) AS r
    FROM flagged_texels t LEFT JOIN c USING (texture_id) GROUP BY 1,2,3""",
    "flagged_texels",
)
def nearest_fill(t):
    filled = texels.pad_outside(t.mask_flags(t.texels))
    return filled.select("texture_id", "x", "y", "source_x", "source_y", "r")


_GLOSS = "SELECT texture_id, x//2 AS x, y//2 AS y, {cols} FROM {src} GROUP BY 1,2,3"
_RE = "round_even(round({v},9),0)::BIGINT"


def _gloss_sql(src):
    return _GLOSS.format(src=src, cols=", ".join(f"{_RE.format(v=f'avg({c})')} AS {c}" for c in "rgba"))


@TEXELS.query("a26_gloss_mip", _gloss_sql("texels"), "texels")
def gloss_mip(t):
    return mips.next_level(t.texels, "gloss", t.texture_sizes)


def _lin(c):
    return f"CASE WHEN {c}/255.0::DOUBLE<=0.04045 THEN {c}/255.0::DOUBLE/12.92 ELSE pow(({c}/255.0::DOUBLE+0.055)/1.055, 2.4) END"


def _srgb(v):
    return f"least(255,greatest(0,round_even(round(255*(CASE WHEN {v}<=0.0031308 THEN {v}*12.92 ELSE 1.055::DOUBLE*pow({v}, 1.0::DOUBLE/2.4)-0.055 END),9),0)))::BIGINT"


def _diffuse_sql(src):
    cols = ", ".join(f"avg({_lin(c)}) AS l{c}" for c in "rgb")
    return f"""SELECT texture_id, x, y, {', '.join(f"{_srgb('l' + c)} AS {c}" for c in 'rgb')}, a FROM (
      SELECT texture_id, x//2 AS x, y//2 AS y, {cols}, {_RE.format(v='avg(a)')} AS a FROM {src} GROUP BY 1,2,3)"""


@TEXELS.query("a27_diffuse_mip", _diffuse_sql("texels"), "texels")
def diffuse_mip(t):
    return mips.next_level(t.texels, "diffuse", t.texture_sizes)


def _enc(v):
    return f"floor(round(least(255.0,greatest(0.0,({v}+1.0)*127.5)),9)+0.5)"


def _packed(x, y):
    """Nested SELECT fields for packed x, y with the disk correction."""
    d = lambda p: f"({p}/127.5::DOUBLE-1.0)"
    px, py = _enc(x), _enc(y)
    ln = f"sqrt({d(px)}*{d(px)}+{d(py)}*{d(py)})"
    fix = lambda p: f"CASE WHEN {ln}>1.0 THEN {_enc(f'{d(p)}/{ln}*0.99')} ELSE {p} END::BIGINT"
    return fix(px), fix(py)


_NX, _NY = _packed("nx/nl", "ny/nl")


@TEXELS.query(
    "a28_normal_mip",
    f"""WITH d AS (SELECT texture_id, x//2 AS x, y//2 AS y, r, b, a/127.5::DOUBLE-1.0 AS vx, g/127.5::DOUBLE-1.0 AS vy FROM texels),
    m AS (SELECT texture_id, x, y, avg(vx) AS nx, avg(vy) AS ny, avg(sqrt(least(1.0,greatest(0.0,1.0-vx*vx-vy*vy)))) AS nz, avg(r) AS r, avg(b) AS b FROM d GROUP BY 1,2,3),
    n AS (SELECT *, greatest(sqrt(nx*nx+ny*ny+nz*nz),1e-8) AS nl FROM m)
    SELECT texture_id, x, y, {_RE.format(v='r')} AS r, {_NY} AS g, {_RE.format(v='b')} AS b, {_NX} AS a FROM n""",
    "texels",
)
def normal_mip(t):
    return mips.next_level(t.texels, "normal", t.texture_sizes)


@TEXELS.query(
    "a29_mip_chain",
    f"""WITH l1 AS ({_gloss_sql('texels')}), l2 AS ({_gloss_sql('l1')}), l3 AS ({_gloss_sql('l2')}), l4 AS ({_gloss_sql('l3')})
    SELECT *, 0 AS level FROM texels UNION ALL BY NAME SELECT *, 1 AS level FROM l1 UNION ALL BY NAME SELECT *, 2 AS level FROM l2
    UNION ALL BY NAME SELECT *, 3 AS level FROM l3 UNION ALL BY NAME SELECT *, 4 AS level FROM l4""",
    "texels",
)
def mip_chain(t):
    return mips.mip_chain(t.texels, "gloss", 5, t.texture_sizes)


# ---- mips of odd sizes: every target texel joined with all texels that overlap it


def _overlap(src, cols):
    """Area-weighted sums of ``cols`` (name, value) of a picture table with its sizes ``z``."""
    part = lambda p, size, half: f"least(({p}+1)*{half}, (t{p}+1)*{size})-greatest({p}*{half}, t{p}*{size})"
    means = ", ".join(f"sum(({v})*sx*sy)/sum(sx*sy) AS {k}" for k, v in cols)
    return f"""SELECT texture_id, tx AS x, ty AS y, {means} FROM (
      SELECT *, {part('x', 'w', 'hw')} AS sx, {part('y', 'h', 'hh')} AS sy FROM (
        SELECT p.*, w, h, greatest(1, w//2) AS hw, greatest(1, h//2) AS hh FROM {src} p JOIN (
          SELECT texture_id, max(x)+1 AS w, max(y)+1 AS h FROM {src} GROUP BY 1) USING (texture_id)),
      unnest(range(greatest(1, w//2))) AS a(tx), unnest(range(greatest(1, h//2))) AS b(ty)
      WHERE x*hw < (tx+1)*w AND tx*w < (x+1)*hw AND y*hh < (ty+1)*h AND ty*h < (y+1)*hh) GROUP BY 1,2,3"""


def _odd_gloss(src):
    return f"SELECT texture_id, x, y, {', '.join(f'{_RE.format(v=c)} AS {c}' for c in 'rgba')} FROM ({_overlap(src, [(c, c) for c in 'rgba'])})"


def _odd_diffuse(src):
    cols = [(f"l{c}", _lin(c)) for c in "rgb"] + [("ma", "a")]
    rgb = ", ".join(f"{_srgb('l' + c)} AS {c}" for c in "rgb")
    return f"SELECT texture_id, x, y, {rgb}, {_RE.format(v='ma')} AS a FROM ({_overlap(src, cols)})"


def _odd_normal(src):
    vx, vy = "(a/127.5::DOUBLE-1.0)", "(g/127.5::DOUBLE-1.0)"
    cols = [("nx", vx), ("ny", vy), ("nz", f"sqrt(least(1.0,greatest(0.0,1.0-{vx}*{vx}-{vy}*{vy})))"), ("mr", "r"), ("mb", "b")]
    return f"""SELECT texture_id, x, y, {_RE.format(v='mr')} AS r, {_NY} AS g, {_RE.format(v='mb')} AS b, {_NX} AS a
      FROM (SELECT *, greatest(sqrt(nx*nx+ny*ny+nz*nz),1e-8) AS nl FROM ({_overlap(src, cols)}))"""


_ODD_LEVELS = 8


def _odd_chain(step):
    levels = ", ".join(f"l{i} AS MATERIALIZED ({step('odd_texels' if i == 1 else f'l{i - 1}')})" for i in range(1, _ODD_LEVELS))
    union = " UNION ALL BY NAME ".join(f"SELECT *, {i} AS level FROM {'odd_texels' if i == 0 else f'l{i}'}" for i in range(_ODD_LEVELS))
    return f"WITH {levels} {union}"


@TEXELS.query("a26_odd_gloss_chain", _odd_chain(_odd_gloss), "odd_texels")
def odd_gloss_chain(t):
    return mips.mip_chain(t.odd_texels, "gloss", _ODD_LEVELS)


@TEXELS.query("a27_odd_diffuse_chain", _odd_chain(_odd_diffuse), "odd_texels")
def odd_diffuse_chain(t):
    return mips.mip_chain(t.odd_texels, "diffuse", _ODD_LEVELS)


@TEXELS.query("a28_odd_normal_chain", _odd_chain(_odd_normal), "odd_texels")
def odd_normal_chain(t):
    return mips.mip_chain(t.odd_texels, "normal", _ODD_LEVELS)


def _odd_mask(src):
    return f"""SELECT texture_id, tx AS x, ty AS y FROM (SELECT *, least((x+1)*hw,(tx+1)*w)-greatest(x*hw,tx*w) AS sx, least((y+1)*hh,(ty+1)*h)-greatest(y*hh,ty*h) AS sy
      FROM (SELECT p.*, greatest(1, w//2) AS hw, greatest(1, h//2) AS hh FROM {src} p), unnest(range(hw)) AS a(tx), unnest(range(hh)) AS b(ty)
      WHERE x*hw < (tx+1)*w AND tx*w < (x+1)*hw AND y*hh < (ty+1)*h AND ty*h < (y+1)*hh)
    GROUP BY texture_id, tx, ty, w, h HAVING 255*sum(sx*sy)::DOUBLE/(w*h) > 0.5"""


def _odd_mask_chain():
    size = lambda i: ", ".join(f"greatest(1, max({c})+1 >> {i}) AS {n}" for c, n in (("x", "w"), ("y", "h")))
    steps = ["m0 AS (SELECT texture_id, x, y FROM odd_texels WHERE (r+g)%7=0)"]
    for i in range(1, _ODD_LEVELS):
        sizes = f"(SELECT texture_id, {size(i - 1)} FROM odd_texels GROUP BY 1)"
        steps.append(f"m{i} AS MATERIALIZED ({_odd_mask(f'(SELECT * FROM m{i - 1} JOIN {sizes} USING (texture_id))')})")
    union = " UNION ALL ".join(f"SELECT texture_id, x, y, {i} AS level FROM m{i}" for i in range(_ODD_LEVELS))
    return f"WITH {', '.join(steps)} {union}"


@TEXELS.query("a29_odd_mask_chain", _odd_mask_chain(), "odd_texels")
def odd_mask_chain(t):
    mask = t.odd_texels.filter((F.col("r") + F.col("g")) % 7 == 0)
    return mips.mask_chain(mask, _ODD_LEVELS, mips.picture_sizes(t.odd_texels))


@TEXELS.query(
    "a30_alpha_projection",
    "SELECT texture_id, x//4 AS x, y//4 AS y, (sum(a)::BIGINT+8)//16 AS a FROM texels GROUP BY 1,2,3",
    "texels",
)
def alpha_projection(t):
    return texels.project_alpha(t.texels, 4)


@TEXELS.query(
    "a33_alignment",
    """WITH p AS (SELECT texture_id, x//4 AS x, y//4 AS y, (sum(a)::BIGINT+8)//16 AS a FROM texels GROUP BY 1,2,3),
    s AS (SELECT texture_id, sum((x+0.5)*a)/sum(a) AS cx, sum((y+0.5)*a)/sum(a) AS cy, min(x) FILTER (a>0) AS x0, min(y) FILTER (a>0) AS y0,
      max(x) FILTER (a>0)+1 AS x1, max(y) FILTER (a>0)+1 AS y1, sum(a)::BIGINT AS s FROM texels GROUP BY 1),
    q AS (SELECT texture_id, sum((x+0.5)*a)/sum(a) AS cx, sum((y+0.5)*a)/sum(a) AS cy, min(x) FILTER (a>0) AS x0, min(y) FILTER (a>0) AS y0,
      max(x) FILTER (a>0)+1 AS x1, max(y) FILTER (a>0)+1 AS y1, sum(a)::BIGINT AS s FROM p GROUP BY 1)
    SELECT texture_id, round(greatest(abs(s.cx/4-q.cx),abs(s.cy/4-q.cy)),6) AS center_error_texels,
    round(greatest(abs(q.x0-s.x0/4.0),abs(q.y0-s.y0/4.0),abs(q.x1-s.x1/4.0),abs(q.y1-s.y1/4.0)),6) AS bbox_edge_error_texels,
    s.s AS source_coverage_sum, q.s AS projected_coverage_sum FROM s JOIN q USING (texture_id)""",
    "texels",
)
def alignment(t):
    return texels.alignment(t.texels, texels.project_alpha(t.texels, 4), 4)


@TEXELS.query(
    "a19_texture_class",
    """SELECT texture_id, CASE WHEN min(r)=255 AND max(r)=255 THEN 'N' WHEN avg(abs(r-g))+avg(abs(g-b))<6 AND avg(a)>250 THEN 'G' ELSE 'D' END AS texture_class
    FROM (SELECT texture_id, CASE WHEN texture_id%3=0 THEN 255 ELSE r END AS r, CASE WHEN texture_id%3=1 THEN r ELSE g END AS g,
      CASE WHEN texture_id%3=1 THEN r ELSE b END AS b, CASE WHEN texture_id%2=0 THEN 255 ELSE a END AS a FROM texels) GROUP BY 1""",
    "texels",
)
def texture_class(t):
    i = F.col("texture_id")
    rows = t.texels.select(
        "texture_id",
        F.when(i % 3 == 0, 255).otherwise(F.col("r")).alias("r"),
        F.when(i % 3 == 1, F.col("r")).otherwise(F.col("g")).alias("g"),
        F.when(i % 3 == 1, F.col("r")).otherwise(F.col("b")).alias("b"),
        F.when(i % 2 == 0, 255).otherwise(F.col("a")).alias("a"),
    )
    return texels.texture_class(rows)


_OTSU = """WITH h AS (SELECT texture_id, r AS bin, count(*) AS n FROM texels GROUP BY 1,2),
    c AS (SELECT *, sum(n) OVER w AS cw, sum(n*bin) OVER w AS cs, sum(n) OVER p AS t, sum(n*bin) OVER p AS g FROM h
      WINDOW w AS (PARTITION BY texture_id ORDER BY bin), p AS (PARTITION BY texture_id))"""


@TEXELS.query(
    "a37_otsu_threshold",
    f"""{_OTSU}, v AS (SELECT texture_id, bin, round(cw::DOUBLE*(t-cw)::DOUBLE*(cs::DOUBLE/cw-(g-cs)::DOUBLE/(t-cw))*(cs::DOUBLE/cw-(g-cs)::DOUBLE/(t-cw)),6) AS v FROM c WHERE cw<t AND bin<255),
    b AS (SELECT texture_id, bin AS threshold FROM v QUALIFY row_number() OVER (PARTITION BY texture_id ORDER BY v DESC, bin)=1)
    SELECT i.texture_id, coalesce(threshold,127) AS threshold FROM (SELECT DISTINCT texture_id FROM h) i LEFT JOIN b USING (texture_id)""",
    "texels",
)
def otsu(t):
    return texels.otsu_threshold(t.texels, "r")


@TEXELS.query("w01_running_histogram", f"{_OTSU} SELECT texture_id, bin, cw::BIGINT AS weight, cs::BIGINT AS weighted_sum FROM c", "texels")
def running_histogram(t):
    return texels.running_histogram(t.texels, "r")


_GRAY = "round({p}r*0.299::DOUBLE+{p}g*0.587::DOUBLE+{p}b*0.114::DOUBLE,0)"


def _sobel_sql(name, src):
    return f"""{name}_g AS (SELECT texture_id, x, y, {_GRAY.format(p='')} AS v FROM {src}),
    {name}_m AS (SELECT texture_id, cx AS x, cy AS y, round(sqrt(pow(sum(dx*(2-abs(dy))*v),2)+pow(sum(dy*(2-abs(dx))*v),2)),6) AS m FROM (
      SELECT texture_id, x-dx AS cx, y-dy AS cy, dx, dy, v FROM {name}_g, range(-1,2) i(dx), range(-1,2) j(dy)) GROUP BY 1,2,3 HAVING count(*)=9),
    {name} AS (SELECT texture_id, x, y FROM {name}_m JOIN (SELECT texture_id, greatest(8.0, quantile_cont(m,0.85)) AS high FROM {name}_m WHERE m>0 GROUP BY 1) USING (texture_id) WHERE m>=high)"""


_EDGE = f"""{_sobel_sql('eb', 'texels')}, {_sobel_sql('ea', 'edited_texels')},
    cb AS (SELECT texture_id, count(*) AS n FROM eb GROUP BY 1), ca AS (SELECT texture_id, count(*) AS n FROM ea GROUP BY 1),
    kb AS (SELECT texture_id, count(*) AS k FROM eb WHERE EXISTS (SELECT 1 FROM ea WHERE ea.texture_id=eb.texture_id AND abs(ea.x-eb.x)<=2 AND abs(ea.y-eb.y)<=2) GROUP BY 1),
    ka AS (SELECT texture_id, count(*) AS k FROM ea WHERE EXISTS (SELECT 1 FROM eb WHERE ea.texture_id=eb.texture_id AND abs(ea.x-eb.x)<=2 AND abs(ea.y-eb.y)<=2) GROUP BY 1),
    f1 AS (SELECT texture_id, coalesce(cb.n,0) AS source_edges, coalesce(ca.n,0) AS edited_edges, CASE WHEN least(coalesce(cb.n,0),coalesce(ca.n,0))>=8 THEN coalesce(kb.k,0)::DOUBLE/cb.n END AS rt,
      CASE WHEN least(coalesce(cb.n,0),coalesce(ca.n,0))>=8 THEN coalesce(ka.k,0)::DOUBLE/ca.n END AS al FROM cb FULL JOIN ca USING (texture_id) LEFT JOIN kb USING (texture_id) LEFT JOIN ka USING (texture_id)),
    f2 AS (SELECT texture_id, source_edges, edited_edges, round(rt,8) AS retention, round(al,8) AS alignment, round(CASE WHEN rt+al>0 THEN 2*rt*al/(rt+al) WHEN rt IS NOT NULL THEN 0.0 END,8) AS structure_f1 FROM f1)"""


def _gray():
    return F.round(F.col("r") * 0.299 + F.col("g") * 0.587 + F.col("b") * 0.114, 0)


def _edge_scores(t):
    return texels.edge_overlap(
        texels.sobel_edges(t.texels, _gray()), texels.sobel_edges(t.edited_texels, _gray()), SIZE, minimum=8
    )


@TEXELS.query("a24_edge_overlap", f"WITH {_EDGE} SELECT * FROM f2", "texels edited_texels")
def edge_overlap(t):
    return _edge_scores(t)


@TEXELS.query(
    "a23_pair_validation",
    f"""WITH {_EDGE}, {_PAIRS}, s AS (SELECT texture_id, count(*) FILTER (ba<>aa)=0 AS alpha_equal, round(avg(ch::INT),8) AS changed_fraction FROM pr GROUP BY 1)
    SELECT texture_id, alpha_equal, changed_fraction, structure_f1, alpha_equal AND changed_fraction>0 AND (structure_f1 IS NULL OR structure_f1>=0.9) AS passed
    FROM s LEFT JOIN f2 USING (texture_id)""",
    _NEED,
)
def pair_validation(t):
    return texels.pair_validation(_pairs(t), _edge_scores(t), 0.9)


def _channel_errors():
    parts = [
        f"""SELECT texture_id, least(max(x)+1,max(y)+1) AS side, '{c}' AS channel, round(avg(abs(b{c}-a{c})),6) AS mae, round(quantile_cont(abs(b{c}-a{c}),0.95),6) AS p95,
        round(quantile_cont(abs(b{c}-a{c}),0.99),6) AS p99, max(abs(b{c}-a{c})) AS maximum FROM pr GROUP BY 1"""
        for c in "rgba"
    ]
    return " UNION ALL ".join(parts)


@TEXELS.query(
    "a25_roundtrip_errors",
    f"""WITH {_PAIRS}, e AS ({_channel_errors()}) SELECT *, mae<=greatest(6.0, CASE WHEN side=4 THEN 24.0 WHEN side<=16 THEN 16.0 WHEN side<=32 THEN 12.0 WHEN side<=64 THEN 8.0 ELSE 0 END)
    AND p99<=CASE WHEN side<=32 THEN 80 ELSE 64 END AND maximum<=128 AS within_limits FROM e""",
    _NEED,
)
def roundtrip(t):
    return texels.roundtrip_errors(texels.paired(t.texels, t.edited_texels), "diffuse")


@TEXELS.query(
    "a52_payload_size",
    """SELECT p_partkey, sum(((greatest(w>>l,1)+3)//4)*((greatest(h>>l,1)+3)//4)*16)::BIGINT AS bytes FROM (
    SELECT p_partkey, (1<<(p_partkey%13)::INT)::BIGINT AS w, (1<<(p_partkey%11)::INT)::BIGINT AS h FROM part), range(13) t(l)
    WHERE l<=log2(greatest(w,h)) GROUP BY 1""",
)
def payload(t):
    p = F.col("p_partkey")
    w = F.call_function("shiftleft", F.lit(1).cast("long"), (p % 13).cast("int"))
    h = F.call_function("shiftleft", F.lit(1).cast("long"), (p % 11).cast("int"))
    return t.part.select(p, w.alias("w"), h.alias("h")).select("p_partkey", texels.payload_size(F.col("w"), F.col("h")).alias("bytes"))


@TEXELS.query(
    "a54_panel_boxes",
    """SELECT target_id||face AS panel, greatest(0,min(x0)-8) AS x0, greatest(0,min(y0)-8) AS y0, least(400,max(x1)+8) AS x1, least(400,max(y1)+8) AS y1 FROM regions GROUP BY 1""",
    "regions",
)
def panel_boxes(t):
    rows = t.regions.select(F.concat("target_id", "face").alias("panel"), "x0", "y0", "x1", "y1")
    return texels.panel_boxes(rows, 8, 400, 400)


@TEXELS.query(
    "a54_context_crops",
    """WITH b AS (SELECT region_id AS panel, x0, y0, x1, y1, greatest(x1-x0,y1-y0)+16 AS side FROM regions)
    SELECT panel, CASE WHEN side<=120 THEN least(120-side, greatest(0, round_even(x0+(x1-x0)/2.0-side/2.0,0)))::BIGINT ELSE greatest(0,x0-8) END AS crop_x,
    CASE WHEN side<=120 THEN least(120-side, greatest(0, round_even(y0+(y1-y0)/2.0-side/2.0,0)))::BIGINT ELSE greatest(0,y0-8) END AS crop_y,
    CASE WHEN side<=120 THEN side ELSE least(120,x1+8)-greatest(0,x0-8) END AS crop_w, CASE WHEN side<=120 THEN side ELSE least(120,y1+8)-greatest(0,y0-8) END AS crop_h FROM b""",
    "regions",
)
def context_crops(t):
    rows = t.regions.select(F.col("region_id").alias("panel"), "x0", "y0", "x1", "y1")
    return texels.context_crop(rows, 8, 120, 120)


@TEXELS.query(
    "a57_neutralization",
    f"""WITH {_PAIRS} SELECT texture_id, count(*) FILTER (ch OR ba<>aa) AS changed_pixels, count(*) FILTER ((ch OR ba<>aa) AND NOT old_text) AS changed_outside_mask,
    sum((br<>ar)::INT+(bb<>ab)::INT)::BIGINT AS changed_unselected_channels FROM pr GROUP BY 1""",
    _NEED,
)
def neutralization(t):
    return texels.neutralization_metrics(_pairs(t), F.col("old_text"), ["g", "a"])


_COLOR = "least(sqrt(pow(r-130,2)+pow(g-120,2)+pow(b-128,2)), sqrt(pow(r-100,2)+pow(g-150,2)+pow(b-128,2)))<=40 AND sqrt(pow(r-128,2)+pow(g-128,2)+pow(b-128,2))>=5 AND r*0.2126+g*0.7152+b*0.0722<=150"


def _condition():
    return texels.color_condition([[130, 120, 128], [100, 150, 128]], 40, [128, 128, 128], (5, None), (None, 150))


@TEXELS.query("p16_color_selection", f"SELECT texture_id, x, y FROM texels WHERE {_COLOR}", "texels")
def color_selection(t):
    return t.texels.filter(_condition()).select(*texels.KEY)


@TEXELS.query(
    "p17_shape_selection",
    """SELECT 'rect' AS shape, texture_id, x, y FROM texels WHERE x>=3 AND x<9 AND y>=2 AND y<12
    UNION ALL SELECT 'ring', texture_id, x, y FROM (SELECT *, sqrt((x-7.5::DOUBLE)*(x-7.5)+(y-7.5::DOUBLE)*(y-7.5)) AS d,
      (degrees(atan2(y-7.5::DOUBLE, x-7.5::DOUBLE))+360.0::DOUBLE)%360.0 AS ang FROM texels) WHERE d>=2 AND d<=6.5 AND (ang>=300 OR ang<=60.5)""",
    "texels",
)
def shape_selection(t):
    rect = t.texels.filter(texels.in_rectangle(3, 2, 9, 12)).select(F.lit("rect").alias("shape"), *texels.KEY)
    ring = texels.in_annulus(7.5, 7.5, 2.0, 6.5, F.lit(300.0), F.lit(60.5))
    return rect.unionByName(t.texels.filter(ring).select(F.lit("ring").alias("shape"), *texels.KEY))


_POLY = [(2, 1), (13, 4), (9, 9), (14, 14), (3, 12)]


@TEXELS.query(
    "p18_polygon_selection",
    "WITH e(x0,y0,x1,y1) AS (VALUES "
    + ", ".join(f"({a[0]},{a[1]},{b[0]},{b[1]})" for a, b in zip(_POLY, _POLY[1:] + _POLY[:1]))
    + """) SELECT 1 AS polygon, texture_id, x, y FROM texels t, e WHERE least(y0,y1)<=y AND y<greatest(y0,y1)
      AND x0+(y+0.5-y0)*(x1-x0)/(y1-y0)::DOUBLE<=x+0.5 GROUP BY texture_id, x, y HAVING count(*)%2=1""",
    "texels",
)
def polygon_selection(t):
    edges = zip(_POLY, _POLY[1:] + _POLY[:1])
    sides = F.array(*[
        F.struct(*[F.lit(v).cast("long").alias(n) for n, v in zip(("x0", "y0", "x1", "y1"), (*a, *b))]) for a, b in edges
    ])
    placed = t.texels.select("texture_id").distinct().select("texture_id", F.lit(1).alias("polygon"), F.inline(sides))
    return texels.polygon_texels(t.texels, placed)


_BOXES = """bx AS (SELECT user_id%32 AS texture_id, event_id AS box_id, event_id%14-1 AS x0, event_id*7%13-1 AS y0, event_id%14+k%9 AS x1, event_id*7%13+k%7 AS y1, k FROM events_k)"""


def _ratio(flag):
    return f"""(SELECT b.box_id, CASE WHEN least(16,x1)>greatest(0,x0) AND least(16,y1)>greatest(0,y0) THEN
      count(m.x)::DOUBLE/((least(16,x1)-greatest(0,x0))*(least(16,y1)-greatest(0,y0))) ELSE 0.0 END AS ratio
      FROM bx b LEFT JOIN mask_texels m ON m.texture_id=b.texture_id AND m.{flag} AND m.x>=b.x0 AND m.x<b.x1 AND m.y>=b.y0 AND m.y<b.y1 GROUP BY b.box_id, x0,y0,x1,y1)"""


def _boxes(t):
    e, k = F.col("event_id"), F.col("k")
    return t.events_k.select(
        (F.col("user_id") % 32).alias("texture_id"), e.alias("box_id"), (e % 14 - 1).alias("x0"), (e * 7 % 13 - 1).alias("y0"),
        (e % 14 + k % 9).alias("x1"), (e * 7 % 13 + k % 7).alias("y1"), "k",
    )


@TEXELS.query("j26_box_mask_overlap", f"WITH {_BOXES} SELECT box_id, ratio FROM {_ratio('editable')}", "events_k mask_texels")
def box_mask_overlap(t):
    return words.box_mask_shares(_boxes(t), t.mask_texels, ["editable"], *SIZE).select("box_id", F.col("editable").alias("ratio"))


_WORDS = ["beer", "stop", "warning", "facts", "zz", "ab", ""]


@TEXELS.query(
    "j25_foreign_triage",
    f"""WITH {_BOXES}, w AS (SELECT texture_id, box_id, ({_WORDS!r})[k%7+1] AS key FROM bx WHERE k%3<>0),
    r AS (SELECT e.box_id, e.ratio AS editable, o.ratio AS old_text, n.ratio AS new_text FROM {_ratio('editable')} e JOIN {_ratio('old_text')} o USING (box_id) JOIN {_ratio('new_text')} n USING (box_id))
    SELECT box_id, key, CASE WHEN (key='stop' AND texture_id%2=0) OR (key<>'' AND (contains('beerfacts', key) OR contains(key,'beerfacts'))) THEN 'allowed'
      WHEN new_text>0.05 OR old_text>0.05 THEN 'ambiguous' ELSE 'foreign' END AS verdict FROM w JOIN r USING (box_id) WHERE editable>0.05""",
    "events_k mask_texels",
)
def foreign_triage(t):
    boxes = _boxes(t)
    ratios = words.box_mask_shares(boxes, t.mask_texels, ["editable", "old_text", "new_text"], *SIZE).drop("texture_id")
    detections = boxes.select(
        "texture_id", "box_id", pick(_WORDS, F.col("k") % 7).alias("key"), (F.col("k") % 3 != 0).alias("foreign")
    )
    ids = t.texels.select("texture_id").distinct()
    expected = ids.withColumn("key", F.lit("beerfacts"))
    preserved = ids.filter("texture_id % 2 = 0").withColumn("key", F.lit("stop"))
    return texels.foreign_triage(detections, ratios, expected, preserved).select("box_id", "key", "verdict")


_RECT = "rg AS (SELECT texture_id, g AS region_id, g*7+1 AS x0, 2 AS y0, g*7+7 AS x1, 13 AS y1 FROM (SELECT DISTINCT texture_id FROM texels), range(2) t(g))"
_RECIPE = f"""{_RECT}, pk AS (SELECT rg.*, t.x, t.y FROM texels t JOIN rg USING (texture_id) WHERE t.x>=x0 AND t.x<x1 AND t.y>=y0 AND t.y<y1 AND {_COLOR}),
    gr AS (SELECT DISTINCT pk.texture_id, region_id, px AS x, py AS y FROM pk, range(16) a(px), range(16) b(py) WHERE abs(px-pk.x)<=1 AND abs(py-pk.y)<=1 AND px>=x0 AND px<x1 AND py>=y0 AND py<y1),
    sl AS (SELECT gr.* FROM gr ANTI JOIN (SELECT * FROM mask_texels WHERE seam_guard) s ON s.texture_id=gr.texture_id AND s.x=gr.x AND s.y=gr.y)"""


def _recipe(t):
    ids = t.texels.select("texture_id").distinct()
    regions = ids.withColumn("region_id", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long")))).select(
        "texture_id", "region_id", (F.col("region_id") * 7 + 1).alias("x0"), F.lit(2).alias("y0"), (F.col("region_id") * 7 + 7).alias("x1"), F.lit(13).alias("y1")
    )
    return regions, texels.recipe_selection(t.texels, regions, _condition(), 1, t.mask("seam_guard"), SIZE)


@TEXELS.query("x02_mask_recipe", f"WITH {_RECIPE} SELECT texture_id, region_id, x, y FROM sl", "texels mask_texels")
def mask_recipe(t):
    return _recipe(t)[1]


@TEXELS.query(
    "x02_recipe_report",
    f"""WITH {_RECIPE}, c AS (SELECT texture_id, region_id, count(*) AS n FROM sl GROUP BY 1,2)
    SELECT rg.texture_id, rg.region_id, coalesce(n,0) AS pixels, CASE WHEN n IS NULL THEN 'empty_selection' END AS violation FROM rg LEFT JOIN c USING (texture_id, region_id)""",
    "texels mask_texels",
)
def recipe_report(t):
    regions, selected = _recipe(t)
    return texels.recipe_report(selected, regions, t.mask("seam_guard"))


_LAYERS = """ly AS (SELECT texture_id, (x//8) AS region_id, x, y, b AS r, r AS g, g AS b, CASE WHEN (x+y)%15=0 THEN greatest(a,1) ELSE 0 END AS a FROM texels)"""


def _layers(t):
    return t.texels.select(
        "texture_id", div(F.col("x"), 8).alias("region_id"), "x", "y", F.col("b").alias("r"), F.col("r").alias("g"), F.col("g").alias("b"),
        F.when((F.col("x") + F.col("y")) % 15 == 0, F.greatest("a", F.lit(1))).otherwise(0).alias("a"),
    )


def _mix(c):
    return f"CASE WHEN l.a>0 AND m.editable THEN least(255,greatest(0,round_even(round(l.{c}*(l.a/255.0::DOUBLE)+t.{c}*(1.0-l.a/255.0::DOUBLE),9),0)))::BIGINT ELSE t.{c} END AS {c}"


@TEXELS.query(
    "x06_lettering_composition",
    f"""WITH {_LAYERS} SELECT t.texture_id, t.x, t.y, {_mix('r')}, {_mix('g')}, {_mix('b')}, t.a FROM texels t
    JOIN ly l USING (texture_id,x,y) JOIN mask_texels m USING (texture_id,x,y)""",
    "texels mask_texels",
)
def lettering(t):
    return texels.compose_lettering(t.texels, _layers(t), t.mask("editable"))


@TEXELS.query(
    "x06_layer_report",
    f"""WITH {_LAYERS}, v AS (SELECT texture_id, x, y, count(*) AS n FROM (SELECT * FROM ly WHERE a>0 UNION ALL SELECT * FROM ly WHERE a>0 AND x=0) WHERE y<>15 GROUP BY 1,2,3)
    SELECT texture_id, count(*) FILTER (n>1) AS overlapping_texels, count(*) FILTER (n IS NOT NULL AND m.x IS NULL) AS outside_new_text, count(*) FILTER (n IS NULL) AS missing_texels
    FROM v FULL JOIN (SELECT * FROM mask_texels WHERE new_text AND x<>3) m USING (texture_id,x,y) GROUP BY 1""",
    "texels mask_texels",
)
def layer_report(t):
    layers = _layers(t)
    doubled = layers.unionByName(layers.filter("x = 0")).filter("y <> 15")
    return texels.layer_report(doubled, t.mask("new_text").filter("x <> 3"))


@TEXELS.query(
    "x12_master_alpha",
    f"WITH {_LAYERS} SELECT texture_id, x, y, a FROM ly WHERE a>0",
    "texels",
)
def master_alpha(t):
    layers = _layers(t)
    return texels.master_alpha(layers, layers.filter("a > 0"))[0]


@TEXELS.query(
    "x12_region_support",
    f"""WITH {_LAYERS} SELECT texture_id, region_id, count(*) FILTER (a>0) AS support, count(*) FILTER (a>0 AND y=15) AS support_mismatch, 0 AS overlaps
    FROM ly WHERE a>0 GROUP BY 1,2""",
    "texels",
)
def region_support(t):
    layers = _layers(t)
    return texels.master_alpha(layers, layers.filter("a > 0 and y <> 15"))[1]


@TEXELS.query(
    "x07_patch_restore",
    """SELECT t.texture_id, t.x, t.y, t.r, CASE WHEN old_text THEN e.g ELSE t.g END AS g, t.b, CASE WHEN old_text THEN e.r ELSE t.a END AS a
    FROM texels t JOIN edited_texels e USING (texture_id,x,y) JOIN mask_texels m USING (texture_id,x,y)""",
    _NEED,
)
def patch_restore(t):
    patch = t.edited_texels.withColumn("a", F.col("r"))
    return texels.restore_patch(t.texels, patch, t.mask("old_text"), ["g", "a"])


@TEXELS.query(
    "x08_masked_layer",
    """SELECT texture_id, x, y, CASE WHEN s>0 THEN r ELSE 0 END AS r, CASE WHEN s>0 THEN g ELSE 0 END AS g, CASE WHEN s>0 THEN b ELSE 0 END AS b,
    CASE WHEN s>0 THEN (a*s+127)//255 ELSE 0 END AS a FROM (SELECT *, CASE WHEN x<4 THEN 0 ELSE x*17 END AS s FROM texels)""",
    "texels",
)
def masked_layer(t):
    return texels.masked_layer(t.texels, F.when(F.col("x") < 4, 0).otherwise(F.col("x") * 17))


@TEXELS.query(
    "f20_normal_shading",
    """WITH v AS (SELECT texture_id, x, y, a/127.5::DOUBLE-1.0 AS nx, g/127.5::DOUBLE-1.0 AS ny FROM texels), z AS (SELECT *, sqrt(greatest(0.0,1.0-nx*nx-ny*ny)) AS nz FROM v),
    n AS (SELECT *, greatest(1e-6, sqrt(nx*nx+ny*ny+nz*nz)) AS l FROM z)
    SELECT texture_id, x, y, least(255,greatest(0,round_even(round(((nx/l*(0.6::DOUBLE)+ny/l*(0.0::DOUBLE)+nz/l*(0.8::DOUBLE))*0.5+0.5)*255.0,9),0)))::BIGINT AS shade FROM n""",
    "texels",
)
def shading(t):
    return t.texels.select(*texels.KEY, color.normal_shade(F.col("g"), F.col("a"), (3.0, 0.0, 4.0)).alias("shade"))


@TEXELS.query(
    "f21_alpha_flattening",
    "SELECT texture_id, x, y, floor(round((r*a+255*(255-a))/255.0::DOUBLE,9)+0.5)::BIGINT AS on_white, floor(round((r*a)/255.0::DOUBLE,9)+0.5)::BIGINT AS on_black FROM texels",
    "texels",
)
def flattening(t):
    return t.texels.select(
        *texels.KEY, color.flatten_alpha(F.col("r"), F.col("a"), 255).alias("on_white"), color.flatten_alpha(F.col("r"), F.col("a"), 0).alias("on_black")
    )


_PX, _PY = _packed("nx", "ny")


@TEXELS.query(
    "f16_normal_codec",
    f"""WITH v AS (SELECT texture_id, x, y, a/127.5::DOUBLE-1.0 AS vx, g/127.5::DOUBLE-1.0 AS vy FROM texels), s AS (SELECT *, greatest(1.0, sqrt(vx*vx+vy*vy)) AS k FROM v),
    n AS (SELECT texture_id, x, y, vx/k*3 AS nx, vy/k*3 AS ny, vx/k AS dx, vy/k AS dy FROM s)
    SELECT texture_id, x, y, round(sqrt(greatest(0.0,1.0-dx*dx-dy*dy)),9) AS z, {_PX} AS packed_x, {_PY} AS packed_y FROM n""",
    "texels",
)
def normal_codec(t):
    n = color.decode_normal(F.col("g"), F.col("a"))
    px, py = color.pack_normal(n["x"] * 3, n["y"] * 3)
    return t.texels.select(*texels.KEY, F.round(n["z"], 9).alias("z"), px.alias("packed_x"), py.alias("packed_y"))


@TEXELS.query(
    "p22_shrink_relation",
    """SELECT p_partkey, w%tw=0 AND h%th=0 AND w//tw=h//th AND bit_count(w//tw)=1 AS shrinks FROM (
    SELECT p_partkey, 64*(1+p_partkey%5) AS w, 64*(1+p_partkey%7) AS h, 16*(1+p_partkey%5) AS tw, 8*(1+p_partkey%3) AS th FROM part)""",
)
def shrink(t):
    p = F.col("p_partkey")
    return t.part.select(
        "p_partkey",
        texels.power_of_two_shrink(64 * (1 + p % 5), 64 * (1 + p % 7), 16 * (1 + p % 5), 8 * (1 + p % 3)).alias("shrinks"),
    )


@TEXELS.query(
    "a60_shared_mask_equality",
    f"""WITH t AS (SELECT texture_id//4 AS plan, texture_id, sha256(x||','||y) AS h FROM mask_texels WHERE protected AND NOT (texture_id%8=5 AND x=7)),
    d AS ({tree_digest_sql('t', ['plan', 'texture_id'])})
    SELECT plan, count(DISTINCT digest)=1 AS equal, count(*) AS targets FROM d GROUP BY 1""",
    "mask_texels",
)
def shared_masks(t):
    rows = t.mask("protected").filter("not (texture_id % 8 = 5 and x = 7)").select(
        div(F.col("texture_id"), 4).alias("plan"), "texture_id", "x", "y"
    )
    digests = texels.texel_digest(rows, ["plan", "texture_id"])
    return digests.groupBy("plan").agg(
        (F.min("digest") == F.max("digest")).alias("equal"), F.count("*").alias("targets")
    )
