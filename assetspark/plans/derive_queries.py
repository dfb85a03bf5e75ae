"""Derived maps, per-level invariants, effect measurements, meshes, ranges."""

from pyspark.sql import functions as F

from ..operators import effects, mesh, mips, ranges, texels
from .registry import Registry
from .texel_queries import _gloss_sql, _packed

DERIVE = Registry()

# textures are 16 wide; h is the number of rows, at which y wraps
_HEIGHTS = "(SELECT texture_id, count(DISTINCT y) AS h FROM texels GROUP BY 1)"
_FULL = f"ft AS (SELECT t.*, h FROM texels t JOIN {_HEIGHTS} USING (texture_id))"


_BLUR_X = """SELECT t.texture_id, t.x, t.y, t.h, sum(CASE abs(d) WHEN 0 THEN 6 WHEN 1 THEN 4 ELSE 1 END/16.0::DOUBLE*s.v) AS v
    FROM {src} t, range(-2,3) k(d), {src} s WHERE s.texture_id=t.texture_id AND s.y=t.y AND s.x=(t.x+d+16)%16 GROUP BY 1,2,3,4"""
_BLUR_Y = _BLUR_X.replace("s.y=t.y AND s.x=(t.x+d+16)%16", "s.x=t.x AND s.y=(t.y+d+2*t.h)%t.h")
_HEIGHT = f"{_FULL}, al AS (SELECT texture_id, x, y, h, a/255.0::DOUBLE AS v FROM ft), bx AS ({_BLUR_X.format(src='al')}), bl AS ({_BLUR_Y.format(src='bx')})"
_GRAD = """gr AS (SELECT b.texture_id, b.x, b.y, b.v, (e.v-w.v)*0.5 AS gx, (s.v-n.v)*0.5 AS gy FROM bl b
    JOIN bl e ON e.texture_id=b.texture_id AND e.y=b.y AND e.x=(b.x+1)%16 JOIN bl w ON w.texture_id=b.texture_id AND w.y=b.y AND w.x=(b.x+15)%16
    JOIN bl s ON s.texture_id=b.texture_id AND s.x=b.x AND s.y=(b.y+1)%b.h JOIN bl n ON n.texture_id=b.texture_id AND n.x=b.x AND n.y=(b.y+b.h-1)%b.h)"""


def _heights(t):
    return t.texels.select(*texels.KEY, (F.col("a") / 255.0).alias("v"))


@DERIVE.query("w08_binomial_blur", f"WITH {_HEIGHT} SELECT texture_id, x, y, round(v,9) AS v FROM bl", "texels")
def blur(t):
    return mips.binomial_blur(_heights(t), 1).select(*texels.KEY, F.round("v", 9).alias("v"))


@DERIVE.query("w07_wrapped_gradient", f"WITH {_HEIGHT}, {_GRAD} SELECT texture_id, x, y, round(gx,9) AS gx, round(gy,9) AS gy FROM gr", "texels")
def gradient(t):
    out = mips.wrapped_gradient(mips.binomial_blur(_heights(t), 1))
    return out.select(*texels.KEY, F.round("gx", 9).alias("gx"), F.round("gy", 9).alias("gy"))


_DX, _DY = _packed("cx/cl", "cy/cl")
_NORMAL = f"""{_HEIGHT}, {_GRAD}, g2 AS (SELECT texture_id, x, y, round(gx*2.0,12) AS gx, round(gy*2.0,12) AS gy FROM gr),
    bs AS (SELECT f.texture_id, f.x, f.y, f.r, f.g, f.b, f.a, gx, gy, sqrt(gx*gx+gy*gy+1.0) AS ln, f.a/127.5::DOUBLE-1.0 AS ux, f.g/127.5::DOUBLE-1.0 AS uy FROM ft f JOIN g2 USING (texture_id,x,y)),
    b1 AS (SELECT *, ux/greatest(1.0,sqrt(ux*ux+uy*uy)) AS nx, uy/greatest(1.0,sqrt(ux*ux+uy*uy)) AS ny, gx/ln AS ex, -gy/ln AS ey, 1.0/ln AS ez FROM bs),
    b2 AS (SELECT *, sqrt(greatest(0.0,1.0-nx*nx-ny*ny))+1.0 AS tz FROM b1),
    b3 AS (SELECT *, (nx*ex+ny*ey+tz*ez)/greatest(tz,1e-8) AS pull FROM b2),
    b4 AS (SELECT *, nx*pull-ex AS cx, ny*pull-ey AS cy, tz*pull-ez AS cz FROM b3),
    b5 AS (SELECT *, greatest(sqrt(cx*cx+cy*cy+cz*cz),1e-8) AS cl FROM b4),
    dn AS (SELECT texture_id, x, y, r, CASE WHEN abs(gx)>1e-8 OR abs(gy)>1e-8 THEN {_DY} ELSE g END AS g, b, CASE WHEN abs(gx)>1e-8 OR abs(gy)>1e-8 THEN {_DX} ELSE a END AS a,
      abs(gx)>1e-8 OR abs(gy)>1e-8 AS effect, CASE WHEN abs(gx)>1e-8 OR abs(gy)>1e-8 THEN round(cz/cl,6) END AS z FROM b5)"""


def _derived_normal(t):
    return mips.derive_normal(t.texels, t.texels, 2.0, 1, 1)


@DERIVE.query("f18_derive_normal", f"WITH {_NORMAL} SELECT * FROM dn", "texels")
def derive_normal(t):
    return _derived_normal(t)


@DERIVE.query(
    "f18_normal_gates",
    f"""WITH {_NORMAL}, g AS (SELECT dn.texture_id, count(*) FILTER (effect) AS effect_pixels, count(*) FILTER (dn.r<>f.r OR dn.g<>f.g OR dn.b<>f.b OR dn.a<>f.a) AS changed_pixels,
      coalesce(min(z), 1.0) AS min_combined_z, bool_or(f.a>0) AS any_alpha FROM dn JOIN ft f USING (texture_id,x,y) GROUP BY 1)
    SELECT texture_id, effect_pixels, changed_pixels, min_combined_z, min_combined_z<0.5 AS below_minimum_z, any_alpha AND changed_pixels=0 AS no_op FROM g""",
    "texels",
)
def normal_gates(t):
    return mips.normal_gates(t.texels, t.texels, _derived_normal(t), 0.5)


@DERIVE.query(
    "f17_normal_blend",
    f"WITH {_NORMAL} SELECT texture_id, x, y, round(cx/cl,6) AS nx, round(cy/cl,6) AS ny, round(cz/cl,6) AS nz FROM b5",
    "texels",
)
def normal_blend(t):
    from ..functions.color import blend_normals, decode_normal

    slopes = mips.wrapped_gradient(mips.binomial_blur(_heights(t), 1)).select(
        *texels.KEY, (F.col("gx") * 2).alias("gx"), (F.col("gy") * 2).alias("gy")
    )
    rows = t.texels.join(slopes, texels.KEY)
    ln = F.sqrt(F.col("gx") ** 2 + F.col("gy") ** 2 + 1.0)
    n = blend_normals(
        decode_normal(F.col("g"), F.col("a")), {"x": -F.col("gx") / ln, "y": F.col("gy") / ln, "z": 1.0 / ln}
    )
    return rows.select(*texels.KEY, *[F.round(n[k], 6).alias(f"n{k}") for k in "xyz"])


_GL = "gl AS (SELECT t.texture_id, t.x, t.y, CASE WHEN m>0 THEN floor(round(least(255.0,greatest(0.0,r+m/255.0::DOUBLE*-40)),9)+0.5)::BIGINT ELSE r END AS r, CASE WHEN m>0 THEN floor(round(least(255.0,greatest(0.0,g+m/255.0::DOUBLE*25.5)),9)+0.5)::BIGINT ELSE g END AS g, b, a, m>0 AS effect FROM (SELECT *, CASE WHEN (x+y)%15=0 THEN a ELSE 0 END AS m FROM texels) t)"


def _derived_gloss(t):
    alpha = t.texels.withColumn("a", F.when((F.col("x") + F.col("y")) % 15 == 0, F.col("a")).otherwise(0))
    return mips.derive_gloss(t.texels, alpha, {"r": -40.0, "g": 25.5})


@DERIVE.query("f19_derive_gloss", f"WITH {_GL} SELECT * FROM gl", "texels")
def derive_gloss(t):
    return _derived_gloss(t)


_GM = f"""{_GL}, gm AS (SELECT texture_id, count(*) FILTER (effect) AS effect_pixels, count(*) FILTER (t.r<>gl.r OR t.g<>gl.g) AS changed,
    count(*) FILTER ((t.r<>gl.r OR t.g<>gl.g) AND NOT effect) AS outside FROM texels t JOIN gl USING (texture_id,x,y) GROUP BY 1)"""


@DERIVE.query(
    "f19_gloss_metrics",
    f"""WITH {_GM} SELECT texture_id, effect_pixels, changed AS changed_pixels_from_neutral_base, outside AS changed_outside_effect_mask, 0 AS changed_unselected_channels,
    effect_pixels>0 AND changed=0 AS no_op FROM gm""",
    "texels",
)
def gloss_metrics(t):
    return mips.derived_metrics(t.texels, _derived_gloss(t), ["r", "g"])


@DERIVE.query(
    "a56_output_gate",
    f"""WITH {_GM} SELECT texture_id, CASE WHEN texture_id%5=2 THEN h ELSE 0 END AS texel_mismatches, effect_pixels,
    texture_id%5<>2 AND texture_id%3<>0 AS passed FROM gm JOIN {_HEIGHTS} USING (texture_id)""",
    "texels",
)
def output_gate(t):
    derived, base = _derived_gloss(t), t.texels
    expected = derived.withColumn(
        "b", F.when((F.col("texture_id") % 5 == 2) & (F.col("x") == 3), F.col("b") + 1).otherwise(F.col("b"))
    )
    recount = mips.derived_metrics(base, derived, ["r", "g"])
    recorded = recount.select(
        "texture_id", F.when(F.col("texture_id") % 3 == 0, -1).otherwise(F.col("effect_pixels")).alias("effect_pixels"),
        F.col("changed_pixels_from_neutral_base").alias("changed"),
    )
    return mips.output_gate(recorded, derived, expected, base, ["r", "g"])


_CHAINS = f"""b0 AS (SELECT * FROM texels), a0 AS (SELECT * FROM edited_texels), b1 AS ({_gloss_sql('b0')}), a1 AS ({_gloss_sql('a0')}), b2 AS ({_gloss_sql('b1')}), a2 AS ({_gloss_sql('a1')}),
    bc AS (SELECT *, 0 AS level FROM b0 UNION ALL BY NAME SELECT *, 1 AS level FROM b1 UNION ALL BY NAME SELECT *, 2 AS level FROM b2),
    ac AS (SELECT *, 0 AS level FROM a0 UNION ALL BY NAME SELECT *, 1 AS level FROM a1 UNION ALL BY NAME SELECT *, 2 AS level FROM a2),
    mk AS (SELECT texture_id, l AS level, x>>l AS x, y>>l AS y, bool_or(old_text) AS effect, bool_or(protected OR seam_guard) AS guarded, bool_or(covered) AS covered
      FROM mask_texels, (SELECT l::INT AS l FROM range(3) t(l)) GROUP BY 1,2,3,4),
    jn AS (SELECT texture_id, level, mk.*, bc.r<>ac.r OR bc.g<>ac.g OR bc.b<>ac.b AS chrgb, bc.a<>ac.a AS cha, bc.r<>ac.r OR bc.b<>ac.b AS chrb,
      bc.r<>ac.r OR bc.g<>ac.g OR bc.b<>ac.b OR bc.a<>ac.a AS ch FROM bc JOIN ac USING (texture_id,level,x,y) JOIN mk USING (texture_id,level,x,y))"""


def _chains(t):
    return mips.mip_chain(t.texels, "gloss", 3, t.texture_sizes), mips.mip_chain(t.edited_texels, "gloss", 3, t.texture_sizes)


def _level_flags(t):
    """Flags of all levels in one aggregation: any flag of a block counts."""
    level = F.col("level")
    rows = t.mask_texels.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(2))))
    return rows.groupBy(
        "texture_id", "level",
        F.call_function("shiftright", F.col("x"), level).alias("x"), F.call_function("shiftright", F.col("y"), level).alias("y"),
    ).agg(
        F.bool_or("old_text").alias("effect"), F.bool_or(F.col("protected") | F.col("seam_guard")).alias("guarded"),
        F.bool_or("covered").alias("covered"), F.bool_or("seam_guard").alias("seam"),
    )


@DERIVE.query(
    "a43_level_invariants",
    f"""WITH {_CHAINS} SELECT texture_id, level, count(*) FILTER (chrb) AS unselected_changes, count(*) FILTER (ch AND (level=0 OR covered) AND NOT effect) AS changed_outside_effect,
    count(*) FILTER (ch AND guarded AND (level=0 OR NOT effect)) AS changed_guarded FROM jn GROUP BY 1,2""",
    "texels edited_texels mask_texels",
)
def level_invariants(t):
    before, after = _chains(t)
    return mips.level_changes(before, after, _level_flags(t).drop("seam"), ["g", "a"])


@DERIVE.query(
    "a44_seam_metrics",
    f"""WITH {_CHAINS}, sg AS (SELECT DISTINCT texture_id, l AS level, x>>l AS x, y>>l AS y FROM mask_texels, (SELECT l::INT AS l FROM range(3) t(l)) WHERE seam_guard)
    SELECT texture_id, level, count(*) FILTER (chrgb) AS changed_pixels, count(*) FILTER (chrgb AND sg.x IS NOT NULL) AS changed_inside_seam_guard
    FROM jn LEFT JOIN sg USING (texture_id, level, x, y) GROUP BY 1,2""",
    "texels edited_texels mask_texels",
)
def seam_metrics(t):
    before, after = _chains(t)
    return mips.seam_metrics(before, after, mips.mask_chain(t.mask("seam_guard"), 3, t.texture_sizes))


@DERIVE.query(
    "a44_padding_mismatches",
    """WITH c AS (SELECT * FROM flagged_texels WHERE covered), n AS (SELECT t.texture_id, t.x, t.y, arg_min({'r':c.r,'g':c.g,'b':c.b,'a':c.a},
      ((c.x-t.x)*(c.x-t.x)+(c.y-t.y)*(c.y-t.y))*100000+c.y*100+c.x) AS p FROM flagged_texels t JOIN c USING (texture_id) WHERE NOT t.covered GROUP BY 1,2,3)
    SELECT texture_id, count(*) FILTER (t.r<>p.r OR t.g<>p.g OR t.b<>p.b OR t.a<>p.a) AS padding_mismatch_pixels FROM n JOIN texels t USING (texture_id,x,y) GROUP BY 1""",
    "flagged_texels",
)
def padding(t):
    flagged = t.mask_flags(t.texels)
    return mips.padding_mismatches(t.texels, texels.pad_outside(flagged), t.mask("covered"))


# ---- effects --------------------------------------------------------------

_BLOCKS = """eb AS (SELECT *, max(old_text) OVER w AS ob, max(new_text) OVER w AS nb FROM effect_levels WINDOW w AS (PARTITION BY texture_id, level, x//4, y//4))"""
_ST = f"""{_BLOCKS}, st AS (
    SELECT texture_id, level, x, y, covered, 'old-effect-removal' AS stage, old_text AND covered AS dm, ob AS bk, in_g-is_g AS wg, in_a-is_a AS wa, an_g-as_g AS gg, an_a-as_a AS ga FROM eb
    UNION ALL SELECT texture_id, level, x, y, covered, 'new-effect', new_text AND covered, nb, ie_g-in_g, ie_a-in_a, ae_g-an_g, ae_a-an_a FROM eb),
    s1 AS (SELECT *, dm AND (wg<>0 OR wa<>0) AS wn, covered AND bk AND (gg<>0 OR ga<>0) AS gn FROM st),
    pk AS (SELECT texture_id, level, stage, CASE WHEN max(greatest(abs(wg),abs(wa))) FILTER (wn)<=2 THEN 0 ELSE 2 END AS lm FROM s1 GROUP BY 1,2,3),
    s2 AS (SELECT s1.*, dm AND greatest(abs(wg),abs(wa))>lm AS ws, covered AND bk AND greatest(abs(gg),abs(ga))>lm AS gs FROM s1 JOIN pk USING (texture_id, level, stage))"""
_SUP = f"""{_ST}, su AS (SELECT texture_id, level, stage, count(*) FILTER (wn) AS n, count(*) FILTER (wn AND gn) AS kept, count(*) FILTER (ws AND gs) AS bo, count(*) FILTER (ws) AS wc,
      count(*) FILTER (gs) AS gc, coalesce(sum(abs(wg)+abs(wa)) FILTER (ws),0)::BIGINT AS se, coalesce(sum(abs(gg)+abs(ga)) FILTER (gs AND NOT ws),0)::BIGINT AS le,
      coalesce(max(greatest(abs(gg),abs(ga))) FILTER (gs AND NOT ws),0) AS lx FROM s2 GROUP BY 1,2,3)"""


def _rows(t):
    return effects.staged(t.effect_levels, ["g", "a"])


@DERIVE.query(
    "a38_effect_support",
    f"""WITH {_SUP} SELECT texture_id, level, stage, n AS intended_texels, round(CASE WHEN n>0 THEN kept::DOUBLE/n ELSE 1 END,6) AS support_recall,
    round(CASE WHEN gc>0 THEN bo::DOUBLE/gc ELSE 1 END,6) AS support_precision, round(CASE WHEN wc+gc-bo>0 THEN bo::DOUBLE/(wc+gc-bo) ELSE 1 END,6) AS support_iou,
    round(le::DOUBLE/greatest(se,1),6) AS leaked_energy_ratio, lx AS leaked_delta_max FROM su""",
    "effect_levels",
)
def effect_support(t):
    return effects.support_metrics(_rows(t)).drop("leaked_energy", "shape_energy")


@DERIVE.query(
    "a38_effect_alignment",
    f"""WITH {_ST}, ge AS (SELECT texture_id, level, stage, sum((x+0.5)*(abs(wg)+abs(wa))) FILTER (ws)/sum(abs(wg)+abs(wa)) FILTER (ws) AS wx, sum((y+0.5)*(abs(wg)+abs(wa))) FILTER (ws)/sum(abs(wg)+abs(wa)) FILTER (ws) AS wy,
      sum((x+0.5)*(abs(gg)+abs(ga))) FILTER (gs)/sum(abs(gg)+abs(ga)) FILTER (gs) AS gx, sum((y+0.5)*(abs(gg)+abs(ga))) FILTER (gs)/sum(abs(gg)+abs(ga)) FILTER (gs) AS gy,
      greatest(abs(min(x) FILTER (ws)-min(x) FILTER (gs)), abs(min(y) FILTER (ws)-min(y) FILTER (gs)), abs(max(x) FILTER (ws)-max(x) FILTER (gs)), abs(max(y) FILTER (ws)-max(y) FILTER (gs))) AS be FROM s2 GROUP BY 1,2,3)
    SELECT texture_id, level, stage, round(greatest(abs(wx-gx),abs(wy-gy)),6) AS center_error_texels, be AS bbox_edge_error_texels FROM ge WHERE wx IS NOT NULL AND gx IS NOT NULL""",
    "effect_levels",
)
def effect_alignment(t):
    return effects.support_alignment(_rows(t))


@DERIVE.query(
    "a39_effect_energy",
    f"""WITH {_ST}, c AS (SELECT texture_id, level, stage, wg AS w, gg AS g FROM s2 WHERE wn UNION ALL SELECT texture_id, level, stage, wa, ga FROM s2 WHERE wn)
    SELECT texture_id, level, stage, round(sum(abs(g))::DOUBLE/greatest(sum(abs(w)),1),6) AS energy_ratio, round(avg((w*g>0)::INT) FILTER (w<>0),6) AS direction_recall,
    round(coalesce(sum(abs(g)) FILTER (w<>0 AND NOT w*g>0),0)::DOUBLE/greatest(sum(abs(w)),1),6) AS wrong_direction_energy_ratio,
    round(quantile_cont(abs(g-w),0.95),6) AS delta_error_p95, round(quantile_cont(abs(g-w),0.99),6) AS delta_error_p99, max(abs(g-w)) AS delta_error_max FROM c GROUP BY 1,2,3""",
    "effect_levels",
)
def effect_energy(t):
    return effects.energy_metrics(_rows(t))


@DERIVE.query(
    "a40_effect_residual",
    """WITH c AS (SELECT texture_id, level, abs(in_g-is_g) AS rm, abs(ae_g-ie_g) AS rs FROM effect_levels WHERE old_text AND covered
      UNION ALL SELECT texture_id, level, abs(in_a-is_a), abs(ae_a-ie_a) FROM effect_levels WHERE old_text AND covered),
    p AS (SELECT texture_id, level, count(*) AS components, round(sum(rs)::DOUBLE/sum(rm),6) AS residual_energy_ratio, round(avg((rs::DOUBLE/rm>=0.8)::INT),6) AS high_residual_fraction FROM c WHERE rm>=8 GROUP BY 1,2)
    SELECT *, residual_energy_ratio<=CASE WHEN level=0 THEN 0.25 ELSE 0.4 END AND high_residual_fraction<=CASE WHEN level=0 THEN 0.1 ELSE 0.25 END AS within_limits FROM p""",
    "effect_levels",
)
def effect_residual(t):
    return effects.residual_metrics(t.effect_levels, ["g", "a"])


def _vec(p):
    return f"{p}_a/127.5::DOUBLE-1.0 AS {p}x, {p}_g/127.5::DOUBLE-1.0 AS {p}y"


@DERIVE.query(
    "a41_protected_error",
    f"""WITH a AS (SELECT * FROM effect_levels WHERE (protected OR seam_guard) AND covered),
    e AS (SELECT texture_id, level, abs(as_g-ae_g) AS e FROM a UNION ALL SELECT texture_id, level, abs(as_a-ae_a) FROM a),
    p AS (SELECT texture_id, level, round(quantile_cont(e,0.95),6) AS protected_p95, round(quantile_cont(e,0.99),6) AS protected_p99, max(e) AS protected_max FROM e GROUP BY 1,2),
    v AS (SELECT texture_id, level, {_vec('as')}, {_vec('ae')} FROM a),
    z AS (SELECT *, sqrt(greatest(0.0,1.0-asx*asx-asy*asy)) AS asz, sqrt(greatest(0.0,1.0-aex*aex-aey*aey)) AS aez FROM v),
    g AS (SELECT *, round(degrees(acos(least(1.0,greatest(-1.0,asx*aex+asy*aey+asz*aez)))),3) AS ang FROM z)
    SELECT texture_id, level, any_value(protected_p95) AS protected_p95, any_value(protected_p99) AS protected_p99, any_value(protected_max) AS protected_max,
    round(quantile_cont(ang,0.95),3) AS angle_p95, round(quantile_cont(ang,0.99),3) AS angle_p99, max(ang) AS angle_max,
    count(*) FILTER ((sqrt(asx*asx+asy*asy)<=1.0 AND sqrt(aex*aex+aey*aey)>1.0) OR (asz>=0.05 AND aez<0.05)) AS newly_invalid FROM g JOIN p USING (texture_id, level) GROUP BY 1,2""",
    "effect_levels",
)
def protected_error(t):
    return effects.protected_metrics(t.effect_levels, ["g", "a"])


@DERIVE.query(
    "a42_cumulative_leaks",
    f"""WITH {_SUP} SELECT texture_id, stage, round(sum(le)::DOUBLE/greatest(sum(se),1),6) AS cumulative_leaked_energy_ratio,
    sum(se)=0 OR sum(le)::DOUBLE/greatest(sum(se),1)<=CASE stage WHEN 'new-effect' THEN 0.1 ELSE 0.06 END AS within_limit FROM su GROUP BY 1,2""",
    "effect_levels",
)
def cumulative_leaks(t):
    return effects.cumulative_leaks(effects.support_metrics(_rows(t)))


@DERIVE.query(
    "a38_outside_changes",
    f"""WITH {_BLOCKS}, q AS (SELECT *, as_g<>ae_g OR as_a<>ae_a AS ch FROM eb) SELECT texture_id, level, count(*) FILTER (ch AND covered AND NOT (ob OR nb)) AS changed_outside_effect_blocks,
    count(*) FILTER (ch AND (protected OR seam_guard)) AS changed_inside_protected_or_seam, count(*) FILTER (covered AND NOT (ob OR nb)) AS checked_unaffected_texels FROM q GROUP BY 1,2""",
    "effect_levels",
)
def outside_changes(t):
    return effects.outside_changes(t.effect_levels, ["g", "a"])


# ---- meshes ---------------------------------------------------------------

_EDGES = """ed AS (SELECT mesh, submesh, least(p,q) AS lo, greatest(p,q) AS hi FROM (SELECT mesh, submesh, a AS p, b AS q FROM mesh_triangles
    UNION ALL SELECT mesh, submesh, b, c FROM mesh_triangles UNION ALL SELECT mesh, submesh, c, a FROM mesh_triangles))"""


@DERIVE.query("a34_boundary_edges", f"WITH {_EDGES} SELECT mesh, submesh, lo, hi FROM ed GROUP BY ALL HAVING count(*)=1", "mesh_triangles")
def boundary_edges(t):
    return mesh.boundary_edges(t.mesh_triangles, ["mesh", "submesh"])


_MERGE = """sg AS (SELECT mesh, vid, round_even(px/1e-5,0)::BIGINT AS a, round_even(py/1e-5,0)::BIGINT AS b, round_even(pz/1e-5,0)::BIGINT AS c, round_even(u/1e-5,0)::BIGINT AS d, round_even(v/1e-5,0)::BIGINT AS e FROM vertices),
    mv AS (SELECT mesh, vid, min(vid) OVER (PARTITION BY mesh, a, b, c, d, e) AS rep FROM sg)"""


@DERIVE.query("a35_vertex_merge", f"WITH {_MERGE} SELECT mesh, vid, rep FROM mv", "vertices")
def vertex_merge(t):
    return mesh.merge_vertices(t.vertices)


@DERIVE.query(
    "a35_merged_boundary",
    f"""WITH {_MERGE}, e0 AS (SELECT mesh, submesh, a AS p, b AS q FROM vertex_triangles UNION ALL SELECT mesh, submesh, b, c FROM vertex_triangles UNION ALL SELECT mesh, submesh, c, a FROM vertex_triangles),
    e1 AS (SELECT e0.*, x.rep AS rp, y.rep AS rq FROM e0 JOIN mv x ON x.mesh=e0.mesh AND x.vid=p JOIN mv y ON y.mesh=e0.mesh AND y.vid=q)
    SELECT mesh, submesh, min(p) AS p, min(q) AS q FROM e1 GROUP BY mesh, submesh, least(rp,rq), greatest(rp,rq) HAVING count(*)=1""",
    "vertices vertex_triangles",
)
def merged_boundary(t):
    return mesh.merged_boundary(t.vertex_triangles, t.vertices)


@DERIVE.query(
    "a36_mesh_stats",
    """WITH t AS (SELECT mesh, count(DISTINCT submesh) AS submeshes, count(*) AS triangles FROM vertex_triangles WHERE mesh<>3 GROUP BY 1)
    SELECT v.mesh, count(*) AS vertices, min(u) AS u_min, max(u) AS u_max, min(v) AS v_min, max(v) AS v_max, any_value(submeshes) AS submeshes, any_value(triangles) AS triangles
    FROM vertices v JOIN t USING (mesh) GROUP BY 1""",
    "vertices vertex_triangles",
)
def mesh_stats(t):
    return mesh.mesh_stats(t.vertex_triangles.filter("mesh <> 3"), t.vertices)


_REP = """rp AS (SELECT mesh, tri, {moves} FROM uv_triangles, range(-3,4) i(su), range(-3,4) j(sv)
    WHERE su>=ceil(-greatest({us})) AND su<=floor(1-least({us})) AND sv>=ceil(-greatest({vs})) AND sv<=floor(1-least({vs})))"""


def _rep(points):
    moves = ", ".join(f"round((u{p}+su)*31.0,6) AS x{p}, round((1-v{p}-sv)*31.0,6) AS y{p}" for p in points)
    return _REP.format(moves=moves, us=",".join(f"u{p}" for p in points), vs=",".join(f"v{p}" for p in points))


def _side(p, q):
    return f"round((x{q}-x{p})*(y-y{p})-(y{q}-y{p})*(x-x{p}),6)"


_SIDES = [_side("a", "b"), _side("b", "c"), _side("c", "a")]
_COVER = f"""{_rep('abc')}, cv AS (SELECT DISTINCT mesh, x, y FROM rp, range(32) k(x), range(32) l(y) WHERE x>=least(xa,xb,xc) AND x<=greatest(xa,xb,xc) AND y>=least(ya,yb,yc) AND y<=greatest(ya,yb,yc)
    AND NOT (least({','.join(_SIDES)})<0 AND greatest({','.join(_SIDES)})>0))"""
_ESTEP = f"""{_rep('ab')}, es AS (SELECT *, greatest(1, ceil(greatest(abs(xb-xa),abs(yb-ya))))::BIGINT AS st FROM rp),
    ew AS (SELECT DISTINCT mesh, floor(round(xa+(xb-xa)*(i::DOUBLE/st),6)+0.5)::BIGINT AS x, floor(round(ya+(yb-ya)*(i::DOUBLE/st),6)+0.5)::BIGINT AS y FROM es, range(64) m(i) WHERE i<=st),
    et AS (SELECT * FROM ew WHERE x>=0 AND x<32 AND y>=0 AND y<32)"""


@DERIVE.query("x10_triangle_coverage", f"WITH {_COVER} SELECT * FROM cv", "uv_triangles")
def triangle_coverage(t):
    return mesh.triangle_coverage(t.uv_triangles, 32, 32)


@DERIVE.query("x10_edge_texels", f"WITH {_ESTEP} SELECT * FROM et", "uv_triangles")
def edge_texels(t):
    return mesh.edge_texels(t.uv_triangles.select("mesh", "ua", "va", "ub", "vb"), 32, 32)


@DERIVE.query(
    "x11_uv_review",
    f"""WITH {_COVER}, {_ESTEP.replace('rp', 'r2')}, gd AS (SELECT mesh, count(*) AS n FROM (SELECT DISTINCT mesh, px, py FROM et, range(32) k(px), range(32) l(py) WHERE abs(px-x)<=1 AND abs(py-y)<=1) GROUP BY 1),
    cc AS (SELECT mesh, count(*) AS n FROM cv GROUP BY 1), ec AS (SELECT mesh, count(*) AS n FROM uv_triangles GROUP BY 1)
    SELECT ec.mesh, ec.n AS boundary_edge_count, coalesce(gd.n,0) AS guard_pixels, coalesce(cc.n,0) AS coverage_pixels, coalesce(gd.n,0)>0 AND coalesce(cc.n,0)>0 AS passed
    FROM ec LEFT JOIN gd USING (mesh) LEFT JOIN cc USING (mesh)""",
    "uv_triangles",
)
def uv_review(t):
    return mesh.uv_review(t.uv_triangles, t.uv_triangles.select("mesh", "ua", "va", "ub", "vb"), 1, 32, 32)


# ---- ranges ---------------------------------------------------------------

_MERGED = """mg AS (SELECT grp, min(s) AS "start", max(e) AS "end" FROM (SELECT *, sum(f) OVER (PARTITION BY grp ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS isl FROM (
    SELECT grp, "start" AS s, "end" AS e, CASE WHEN "start"<=max("end") OVER (PARTITION BY grp ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS f FROM intervals)) GROUP BY grp, isl)"""


@DERIVE.query("w09_merge_ranges", f'WITH {_MERGED} SELECT grp, "start", "end" FROM mg', "intervals")
def merge_ranges(t):
    return ranges.merge_ranges(t.intervals, bucket=4096)


@DERIVE.query(
    "x09_differences_outside",
    f"""WITH {_MERGED}, b AS (SELECT DISTINCT l_suppkey AS grp, l_orderkey AS pos FROM lineitem),
    o AS (SELECT b.*, pos%7 AS bv, CASE WHEN pos%13=0 THEN 99 ELSE pos%7 END AS av FROM b WHERE NOT EXISTS (SELECT 1 FROM mg WHERE mg.grp=b.grp AND pos>=mg."start" AND pos<mg."end"))
    SELECT grp, pos, bv AS b_value, CASE WHEN pos%17=0 THEN NULL ELSE av END AS a_value FROM o WHERE pos%17=0 OR bv<>av""",
    "intervals",
)
def differences_outside(t):
    base = t.lineitem.select(F.col("l_suppkey").alias("grp"), F.col("l_orderkey").alias("pos")).distinct()
    pos = F.col("pos")
    before = base.withColumn("value", pos % 7)
    after = base.filter(pos % 17 != 0).withColumn("value", F.when(pos % 13 == 0, 99).otherwise(pos % 7))
    return ranges.differences_outside(before, after, ranges.merge_ranges(t.intervals, bucket=4096))
