"""Dependency-graph queries."""

from pyspark.sql import functions as F

from ..functions.arithmetic import div
from ..functions.ids import tree_digest_sql
from ..operators import graph
from .registry import Registry

GRAPH = Registry()

_DIFF = "('_MainTex','_BaseMap','_BaseColorMap')"
_AUX = "('_BumpMap','_NormalMap','_SpecMap','_GlossMap','_MetallicGlossMap')"
_ROLE = "CASE WHEN property IN ('_BumpMap','_NormalMap') THEN 'normal' WHEN property IN ('_SpecMap','_GlossMap','_MetallicGlossMap') THEN 'gloss' END"
_MT = f"mt AS (SELECT DISTINCT s.bundle_key, s.material_path_id, t.target_id FROM slots s JOIN targets t USING (texture_bundle_key, path_id) WHERE property IN {_DIFF})"
_REV = "rev AS (SELECT DISTINCT depends_on AS texture_bundle_key, bundle_key AS dependent FROM deps WHERE bundle_key<>depends_on)"
_APTR = f"""ap AS (SELECT DISTINCT texture_bundle_key, path_id FROM slots s WHERE property IN {_AUX} AND path_id<>0
    AND EXISTS (SELECT 1 FROM mt WHERE mt.bundle_key=s.bundle_key AND mt.material_path_id=s.material_path_id))"""


def _specs(t):
    return t.texture_names.filter("path_id % 7 = 0").select(
        "texture",
        F.when(F.col("path_id") % 2 == 0, F.col("bundle_key")).alias("bundle_key"),
        F.concat(F.lit("t"), F.col("path_id") % 40).alias("target_id"),
    ).distinct()


_SPEC = """sp AS (SELECT DISTINCT texture, CASE WHEN path_id%2=0 THEN bundle_key END AS bundle_key, 't'||(path_id%40) AS target_id
      FROM texture_names WHERE path_id%7=0),
    tx AS (SELECT DISTINCT texture, bundle_key FROM texture_names),
    m AS (SELECT tx.texture, tx.bundle_key, count(DISTINCT target_id) AS n, min(target_id) AS target_id FROM tx JOIN sp
      ON tx.texture=sp.texture AND (sp.bundle_key IS NULL OR sp.bundle_key=tx.bundle_key) GROUP BY 1,2)"""


@GRAPH.query("j01_target_match", f"WITH {_SPEC} SELECT texture, bundle_key, target_id FROM m WHERE n=1", "texture_names")
def target_match(t):
    return graph.match_targets(t.texture_names.select("texture", "bundle_key").distinct(), _specs(t))[0]


@GRAPH.query("j01_ambiguous_targets", f"WITH {_SPEC} SELECT texture, bundle_key, n FROM m WHERE n>1", "texture_names")
def ambiguous_targets(t):
    return graph.match_targets(t.texture_names.select("texture", "bundle_key").distinct(), _specs(t))[1]


@GRAPH.query("j02_reverse_dependencies", f"WITH {_REV} SELECT * FROM rev", "deps")
def reverse_dependencies(t):
    return graph.reverse_dependencies(t.deps)


@GRAPH.query(
    "j03_slot_resolution",
    """WITH tx AS (SELECT DISTINCT bundle_key, path_id%97 AS path_id, min(texture) AS texture FROM texture_names GROUP BY 1,2),
    ex AS (SELECT DISTINCT 'cab-'||(path_id%60) AS low, bundle_key AS owner FROM texture_names),
    s AS (SELECT p_partkey AS slot_id, n.bundle_key, p_partkey%3 AS file_id, p_partkey*5%97 AS path_id, 'CAB-'||(p_partkey%60) AS external_file
      FROM part JOIN texture_names n ON n.path_id=p_partkey),
    l AS (SELECT s.*, tx.bundle_key AS texture_bundle_key, tx.texture FROM s LEFT JOIN tx ON tx.bundle_key=s.bundle_key AND tx.path_id=s.path_id WHERE file_id=0),
    f AS (SELECT low, path_id, min(owner) AS o, min(texture) AS texture FROM ex JOIN tx ON tx.bundle_key=owner GROUP BY 1,2 HAVING count(*)=1)
    SELECT slot_id, file_id, texture_bundle_key, texture FROM l UNION ALL
    SELECT slot_id, file_id, f.o, f.texture FROM s LEFT JOIN f ON lower(external_file)=f.low AND f.path_id=s.path_id WHERE file_id<>0""",
    "texture_names",
)
def slot_resolution(t):
    n = t.texture_names
    textures = n.groupBy("bundle_key", (F.col("path_id") % 97).alias("path_id")).agg(F.min("texture").alias("texture"))
    externals = n.select(F.concat(F.lit("Cab-"), F.col("path_id") % 60).alias("file_name"), F.col("bundle_key").alias("owner_bundle"))
    p = F.col("path_id")
    slots = n.select(
        p.alias("slot_id"), "bundle_key", (p % 3).alias("file_id"), (p * 5 % 97).alias("path_id"),
        F.concat(F.lit("CAB-"), p % 60).alias("external_file"),
    )
    return graph.resolve_slots(slots, externals, textures).select("slot_id", "file_id", "texture_bundle_key", "texture")


@GRAPH.query("j04_material_targets", f"WITH {_MT} SELECT * FROM mt", "slots targets")
def material_targets(t):
    return graph.material_targets(t.slots, t.targets)


@GRAPH.query("j05_auxiliary_pointers", f"WITH {_MT}, {_APTR} SELECT * FROM ap", "slots targets")
def auxiliary_pointers(t):
    return graph.auxiliary_pointers(t.slots, t.targets)


_EXT = f"""{_MT}, {_REV}, kn AS (SELECT DISTINCT bundle_key, material_path_id FROM slots WHERE material_path_id%10=0),
    h1 AS (SELECT DISTINCT s.bundle_key, s.material_path_id FROM slots s JOIN targets t USING (texture_bundle_key, path_id)
      JOIN rev ON rev.texture_bundle_key=s.texture_bundle_key AND rev.dependent=s.bundle_key WHERE property IN {_DIFF}
      AND NOT EXISTS (SELECT 1 FROM kn WHERE kn.bundle_key=s.bundle_key AND kn.material_path_id=s.material_path_id)),
    rc AS (SELECT * FROM h1 UNION SELECT * FROM kn),
    pt AS (SELECT DISTINCT s.texture_bundle_key, s.path_id FROM slots s JOIN rc USING (bundle_key, material_path_id)
      JOIN (SELECT DISTINCT bundle_key, material_path_id FROM mt) m USING (bundle_key, material_path_id) WHERE property IN {_AUX}),
    h2 AS (SELECT DISTINCT s.bundle_key, s.material_path_id FROM slots s JOIN pt USING (texture_bundle_key, path_id)
      JOIN rev ON rev.texture_bundle_key=s.texture_bundle_key AND rev.dependent=s.bundle_key WHERE property IN {_AUX}
      AND NOT EXISTS (SELECT 1 FROM rc WHERE rc.bundle_key=s.bundle_key AND rc.material_path_id=s.material_path_id))"""


@GRAPH.query(
    "j06_external_materials",
    f"WITH {_EXT} SELECT *, 1 AS hop FROM h1 UNION ALL SELECT *, 2 FROM h2",
    "slots targets deps",
)
def external_materials(t):
    known = t.slots.filter("material_path_id % 10 = 0").select(*graph.MATERIAL).distinct()
    return graph.external_materials(t.slots, t.targets, t.deps, known)


@GRAPH.query(
    "j07_unresolved_targets",
    f"""WITH {_MT}, r AS (SELECT DISTINCT target_id FROM mt WHERE material_path_id%4<>0)
    SELECT DISTINCT target_id, 'no_material' AS reason FROM targets WHERE target_id NOT IN (SELECT target_id FROM mt)
    UNION ALL SELECT DISTINCT target_id, 'no_renderer' FROM mt WHERE target_id NOT IN (SELECT target_id FROM r)""",
    "slots targets",
)
def unresolved(t):
    links = graph.material_targets(t.slots, t.targets)
    return graph.unresolved_targets(t.targets, links, links.filter("material_path_id % 4 <> 0"))


@GRAPH.query(
    "j08_all_consumers",
    """SELECT texture_bundle_key, path_id, target_id, bundle_key, material_path_id, property, scale_u, scale_v, offset_u, offset_v
    FROM slots JOIN targets USING (texture_bundle_key, path_id)""",
    "slots targets",
)
def all_consumers(t):
    return graph.consumers_of(t.slots, t.targets)


@GRAPH.query(
    "j09_target_bindings",
    f"""WITH {_MT} SELECT bundle_key, material_path_id, property, texture_bundle_key, path_id FROM slots s
    WHERE EXISTS (SELECT 1 FROM mt WHERE mt.bundle_key=s.bundle_key AND mt.material_path_id=s.material_path_id)""",
    "slots targets",
)
def bindings(t):
    return graph.target_bindings(t.slots, t.targets).select(*graph.MATERIAL, "property", *graph.TEXTURE)


_HALF = f"""h AS (SELECT bundle_key, material_path_id, property, {_ROLE} AS role, CASE WHEN path_id%9=0 THEN 0 ELSE path_id END AS path_id,
    CASE WHEN path_id%9=0 OR path_id%11=0 THEN NULL ELSE 'n'||path_id END AS texture,
    CASE WHEN path_id%9=0 THEN NULL ELSE texture_bundle_key END AS texture_bundle_key FROM slots)"""


def _half(t):
    p = F.col("path_id")
    return t.slots.select(
        "bundle_key", "material_path_id", "property",
        F.when(p % 9 == 0, F.lit(None)).otherwise(F.col("texture_bundle_key")).alias("texture_bundle_key"),
        F.when((p % 9 == 0) | (p % 11 == 0), F.lit(None)).otherwise(F.concat(F.lit("n"), p)).alias("texture"),
        F.when(p % 9 == 0, F.lit(0)).otherwise(p).alias("path_id"),
    )


@GRAPH.query(
    "j10_auxiliary_slots",
    f"WITH {_HALF} SELECT bundle_key, material_path_id, property, role, path_id FROM h WHERE role IS NOT NULL AND path_id<>0 AND texture IS NOT NULL",
    "slots",
)
def auxiliary_slots(t):
    return graph.auxiliary_slots(_half(t))[0].select(*graph.MATERIAL, "property", "role", "path_id")


@GRAPH.query(
    "j10_half_resolved_slots",
    f"WITH {_HALF} SELECT bundle_key, material_path_id, property, role, path_id FROM h WHERE role IS NOT NULL AND path_id<>0 AND texture IS NULL",
    "slots",
)
def half_resolved(t):
    return graph.auxiliary_slots(_half(t))[1].select(*graph.MATERIAL, "property", "role", "path_id")


@GRAPH.query(
    "j11_diffuse_beside_auxiliary",
    f"""WITH p AS (SELECT bundle_key, material_path_id, count(*) FILTER (property IN {_AUX}) AS auxiliary_slots, count(*) FILTER (property IN {_DIFF}) AS diffuse_slots,
      count(DISTINCT {{'a':scale_u,'b':scale_v,'c':offset_u,'d':offset_v}}) FILTER (property IN {_DIFF}) AS nd,
      min({{'a':scale_u,'b':scale_v,'c':offset_u,'d':offset_v}}) FILTER (property IN {_DIFF}) AS lo FROM slots GROUP BY 1,2)
    SELECT bundle_key, material_path_id, auxiliary_slots, diffuse_slots, nd<>1 AS ambiguous, lo.a AS scale_u, lo.c AS offset_u FROM p WHERE auxiliary_slots>0""",
    "slots",
)
def diffuse_beside(t):
    return graph.diffuse_beside_auxiliary(t.slots)


_CLOSE = f"""d AS (SELECT DISTINCT bundle_key, material_path_id, texture_bundle_key, path_id FROM slots WHERE property IN {_DIFF} AND path_id<>0),
    mp AS (SELECT d.*, t.target_id FROM d LEFT JOIN targets t USING (texture_bundle_key, path_id)),
    cl AS (SELECT bundle_key, material_path_id FROM mp GROUP BY 1,2 HAVING bool_and(target_id IS NOT NULL)),
    mem AS (SELECT DISTINCT bundle_key, material_path_id, target_id FROM mp JOIN cl USING (bundle_key, material_path_id)),
    us AS (SELECT DISTINCT texture_bundle_key, path_id, bundle_key, material_path_id FROM slots WHERE (texture_bundle_key, path_id) IN
      (SELECT (texture_bundle_key, path_id) FROM slots WHERE property IN {_AUX})),
    fin AS (SELECT DISTINCT us.texture_bundle_key, us.path_id, coalesce(mem.target_id, '__unmapped_consumer__') AS target_id
      FROM us LEFT JOIN mem USING (bundle_key, material_path_id))"""


def _aux_textures(t):
    return t.slots.filter(graph.auxiliary_role(F.col("property")).isNotNull()).select(*graph.TEXTURE).distinct()


@GRAPH.query("j12_consumer_closure", f"WITH {_CLOSE} SELECT * FROM fin", "slots targets")
def closure(t):
    return graph.consumer_closure(t.slots, t.targets, _aux_textures(t))


_RENDER = f"""{_MT}, rd AS (SELECT o_orderkey AS renderer_id, o_custkey%4+1 AS submesh_count FROM orders),
    ms AS (SELECT o_orderkey AS renderer_id, s AS slot, 'mat/'||((o_orderkey+s)%50) AS bundle_key, o_orderkey+s AS material_path_id
      FROM orders, range(3) x(s) WHERE s<=o_orderkey%3),
    ns AS (SELECT renderer_id, count(*) AS n FROM ms GROUP BY 1),
    pa AS (SELECT renderer_id, sm AS submesh, least(sm, n-1) AS slot FROM rd JOIN ns USING (renderer_id), range(4) y(sm) WHERE sm<submesh_count),
    st AS (SELECT DISTINCT renderer_id, submesh, target_id FROM pa JOIN ms USING (renderer_id, slot) JOIN mt USING (bundle_key, material_path_id))"""


def _renderers(t):
    return t.orders.select(F.col("o_orderkey").alias("renderer_id"), (F.col("o_custkey") % 4 + 1).cast("int").alias("submesh_count"))


def _material_slots(t):
    k = F.col("o_orderkey")
    return (
        t.orders.select(k.alias("renderer_id"), F.explode(F.sequence(F.lit(0).cast("long"), k % 3)).alias("slot"))
        .select(
            "renderer_id", "slot",
            F.concat(F.lit("mat/"), (F.col("renderer_id") + F.col("slot")) % 50).alias("bundle_key"),
            (F.col("renderer_id") + F.col("slot")).alias("material_path_id"),
        )
    )


@GRAPH.query("j13_submesh_targets", f"WITH {_RENDER} SELECT * FROM st", "slots targets")
def submesh_targets(t):
    links = graph.material_targets(t.slots, t.targets)
    return graph.submesh_targets(_renderers(t), _material_slots(t), links)


_DEPS2 = "d2 AS (SELECT bundle_key AS depends_on, 'mat/'||((substr(depends_on,5)::BIGINT*2)%50) AS bundle_key FROM deps)"


@GRAPH.query(
    "j14_material_spread",
    f"""WITH {_MT}, {_DEPS2} SELECT bundle_key, material_path_id, bundle_key AS renderer_bundle, target_id FROM mt
    UNION SELECT mt.bundle_key, material_path_id, d2.bundle_key, target_id FROM mt JOIN d2 ON d2.depends_on=mt.bundle_key AND d2.bundle_key<>d2.depends_on""",
    "slots targets deps",
)
def material_spread(t):
    number = F.substring("depends_on", 5, 10).cast("long")
    deps = t.deps.select(
        F.col("bundle_key").alias("depends_on"), F.concat(F.lit("mat/"), number * 2 % 50).alias("bundle_key")
    )
    return graph.spread_materials(graph.material_targets(t.slots, t.targets), deps)


@GRAPH.query(
    "j14_conflicting_materials",
    f"""WITH {_MT}, v AS (SELECT *, 0 AS source FROM mt UNION ALL SELECT *, 1 FROM mt WHERE length(target_id)%2<>0),
    s AS (SELECT bundle_key, material_path_id, source, string_agg(target_id, ',' ORDER BY target_id) AS ids FROM v GROUP BY 1,2,3)
    SELECT bundle_key, material_path_id, count(DISTINCT ids) AS variants FROM s GROUP BY 1,2 HAVING count(DISTINCT ids)>1""",
    "slots targets",
)
def conflicting(t):
    links = graph.material_targets(t.slots, t.targets)
    both = links.withColumn("source", F.lit(0)).unionByName(
        links.filter(F.length("target_id") % 2 != 0).withColumn("source", F.lit(1))
    )
    return graph.conflicting_identities(both, graph.MATERIAL, "source")


def _fields(columns):
    return "||".join(f"coalesce(length(({c})::VARCHAR)||':'||({c})::VARCHAR,'-')" for c in columns)


_OWNER = ["assets_file", "material_path_id"]
_SLOT = [*_OWNER, "property", "file_id", "path_id", "external_assets_file"] + [f"{c}+0.0::DOUBLE" for c in ("scale_u", "scale_v", "offset_u", "offset_v")]
_LEAVES = f"""lv AS (SELECT bundle_key, sha256('slot'||{_fields(_SLOT)}) AS h, false AS whole FROM raw_slots UNION ALL
      SELECT DISTINCT bundle_key, sha256('material'||{_fields(_OWNER)}), true FROM raw_materials)"""
_COUNTS = {"material_count": "whole", "texture_slot_count": "NOT whole"}
_DIGEST = f"{_LEAVES}, gd AS (SELECT * EXCLUDE (n) FROM ({tree_digest_sql('lv', ['bundle_key'], out='graph_sha256', **_COUNTS)}))"


@GRAPH.query("a45_graph_digest", f"WITH {_DIGEST} SELECT * FROM gd", "raw_slots raw_materials")
def graph_digest(t):
    return graph.graph_digests(t.raw_slots, t.raw_materials)


@GRAPH.query(
    "a46_binding_signature",
    f"""WITH {_MT}, r AS (SELECT *, sha256('slot'||{_fields(['bundle_key', *_SLOT])}) AS h FROM raw_slots WHERE path_id<>0 AND (property IN {_DIFF} OR property IN {_AUX})),
    j AS (SELECT target_id, h FROM r JOIN mt USING (bundle_key, material_path_id))
    SELECT target_id, signature, n AS slots FROM ({tree_digest_sql('j', ['target_id'], out='signature')})""",
    "slots raw_slots targets",
)
def binding_signature(t):
    return graph.binding_signatures(t.raw_slots, t.targets)


@GRAPH.query(
    "a47_contract_conflicts",
    f"""WITH x AS (SELECT *, {_ROLE} AS role FROM slots WHERE property IN {_AUX})
    SELECT 'contract' AS kind, bundle_key||'::'||material_path_id||'::'||property AS conflict_key FROM x GROUP BY bundle_key, material_path_id, property
      HAVING count(DISTINCT {{'a':role,'b':texture_bundle_key,'c':path_id,'d':scale_u,'e':scale_v,'f':offset_u,'g':offset_v}})>1
    UNION ALL SELECT 'two_roles', texture_bundle_key||'::'||path_id FROM x GROUP BY texture_bundle_key, path_id HAVING count(DISTINCT role)>1""",
    "slots",
)
def contract_conflicts(t):
    return graph.contract_conflicts(t.slots)


_PLANS = f"""pl AS (SELECT DISTINCT s.texture_bundle_key, s.path_id, {_ROLE} AS role, mt.target_id, CASE WHEN s.path_id%3=0 THEN mt.target_id ELSE 'neutralize' END AS signature
    FROM slots s JOIN mt USING (bundle_key, material_path_id) WHERE property IN {_AUX})"""


def _aux_plans(t):
    links = graph.material_targets(t.slots, t.targets)
    aux = t.slots.withColumn("role", graph.auxiliary_role(F.col("property"))).filter("role is not null")
    return (
        aux.join(links, graph.MATERIAL)
        .select(*graph.TEXTURE, "role", "target_id", F.when(F.col("path_id") % 3 == 0, F.col("target_id")).otherwise("neutralize").alias("signature"))
        .distinct()
    )


@GRAPH.query(
    "a48_shared_plans",
    f"""WITH {_MT}, {_PLANS} SELECT texture_bundle_key, path_id, role, min(signature) AS signature, count(DISTINCT signature)=1 AS agreed,
    count(DISTINCT target_id) AS targets FROM pl GROUP BY 1,2,3""",
    "slots targets",
)
def shared_plans(t):
    return graph.merge_plans(_aux_plans(t))


_SNAP = f"""{_MT}, {_APTR}, {_REV}, ob AS (SELECT texture_bundle_key FROM targets UNION SELECT texture_bundle_key FROM ap),
    hs AS (SELECT DISTINCT bundle_key, sha256(bundle_key) AS sha256 FROM slots),
    sn AS (SELECT 'reverse' AS kind, rev.texture_bundle_key AS bundle_key, dependent FROM rev WHERE texture_bundle_key IN (SELECT texture_bundle_key FROM ob)
      UNION ALL SELECT 'renderer', rev.texture_bundle_key, dependent FROM rev WHERE texture_bundle_key IN (SELECT bundle_key FROM mt)),
    sh AS (SELECT kind, sn.bundle_key, dependent, hs.sha256 FROM sn LEFT JOIN hs ON hs.bundle_key=dependent)"""


def _snapshot(t):
    hashes = t.slots.select("bundle_key").distinct().withColumn("sha256", F.sha2("bundle_key", 256))
    return graph.dependency_snapshot(t.slots, t.targets, t.deps, hashes)


@GRAPH.query("a50_dependency_snapshot", f"WITH {_SNAP} SELECT kind, bundle_key, dependent, sha256 FROM sh", "slots targets deps")
def snapshot(t):
    return _snapshot(t).select("kind", "bundle_key", "dependent", "sha256")


@GRAPH.query(
    "j20_snapshot_drift",
    f"""WITH {_SNAP}, o AS (SELECT * FROM sh WHERE substr(dependent,5)::INT%7<>0),
    n AS (SELECT kind, bundle_key, dependent, CASE WHEN substr(dependent,5)::INT%5=0 THEN 'x' ELSE sha256 END AS s2 FROM sh WHERE substr(dependent,5)::INT%11<>0),
    j AS (SELECT kind, bundle_key, dependent, o.sha256 AS s1, n.s2, o.kind IS NOT NULL AS ho, n.kind IS NOT NULL AS hn FROM o FULL JOIN n USING (kind, bundle_key, dependent))
    SELECT kind, bundle_key, dependent, CASE WHEN substr(dependent,5)::INT%7=0 OR substr(dependent,5)::INT%11=0 THEN 'catalog_changed' ELSE 'bundle_changed' END AS drift
    FROM j WHERE substr(dependent,5)::INT%7=0 OR substr(dependent,5)::INT%11=0 OR s1 IS DISTINCT FROM s2""",
    "slots targets deps",
)
def drift(t):
    sh = _snapshot(t)
    n = F.substring("dependent", 5, 10).cast("int")
    current = sh.filter(n % 11 != 0).withColumn("sha256", F.when(n % 5 == 0, "x").otherwise(F.col("sha256")))
    return graph.snapshot_drift(sh.filter(n % 7 != 0), current)


@GRAPH.query(
    "j21_hash_pins",
    """SELECT r.path, r.target_id, r.sha256, CASE WHEN c.sha256 IS NULL THEN 'missing' WHEN c.sha256=r.sha256 THEN 'ok' ELSE 'changed' END AS state
    FROM recorded_artifacts r LEFT JOIN current_artifacts c USING (path)""",
    "recorded_artifacts current_artifacts",
)
def hash_pins(t):
    return graph.hash_pins(t.recorded_artifacts, t.current_artifacts)


@GRAPH.query(
    "j22_deployment_rows",
    "SELECT bundle_key, depends_on FROM deps WHERE substr(bundle_key,5)::INT%3=0",
    "deps",
)
def deployment_rows(t):
    wanted = t.slots.filter(F.substring("bundle_key", 5, 10).cast("int") % 3 == 0)
    return graph.deployment_rows(wanted, t.deps)[0]


@GRAPH.query(
    "j22_missing_keys",
    "SELECT DISTINCT bundle_key FROM (SELECT 'mat/'||(l_orderkey%73) AS bundle_key FROM lineitem) WHERE bundle_key NOT IN (SELECT bundle_key FROM deps)",
    "deps",
)
def missing_keys(t):
    wanted = t.lineitem.select(F.concat(F.lit("mat/"), F.col("l_orderkey") % 73).alias("bundle_key"))
    return graph.deployment_rows(wanted, t.deps)[1]


@GRAPH.query(
    "j23_source_bundles",
    """WITH r AS (SELECT target_id AS bundle_key, CASE WHEN substr(path,3)::BIGINT%19=0 THEN sha256 ELSE sha256(target_id) END AS sha256 FROM recorded_artifacts),
    o AS (SELECT bundle_key, min(sha256) AS lo, max(sha256) AS hi FROM r GROUP BY 1),
    c AS (SELECT DISTINCT 't'||o_custkey AS bundle_key, sha256('t'||o_custkey||CASE WHEN o_custkey%5=0 THEN 'x' ELSE '' END) AS live FROM orders WHERE o_custkey%13<>0)
    SELECT bundle_key, CASE WHEN lo<>hi THEN 'several_hashes' WHEN live IS NULL THEN 'missing' WHEN live=lo THEN 'ok' ELSE 'changed' END AS state
    FROM o LEFT JOIN c USING (bundle_key)""",
    "recorded_artifacts",
)
def source_bundles(t):
    key = F.substring("path", 3, 20).cast("long")
    recorded = t.recorded_artifacts.select(
        F.col("target_id").alias("bundle_key"),
        F.when(key % 19 == 0, F.col("sha256")).otherwise(F.sha2("target_id", 256)).alias("sha256"),
    )
    c = F.col("o_custkey")
    name = F.concat(F.lit("t"), c)
    current = t.orders.filter(c % 13 != 0).select(
        name.alias("bundle_key"),
        F.sha2(F.concat(name, F.when(c % 5 == 0, "x").otherwise("")), 256).alias("sha256"),
    ).distinct()
    return graph.source_bundles(recorded, current)


@GRAPH.query(
    "j33_source_overrides",
    """WITH r AS (SELECT 'b'||(p_partkey%300) AS bundle_key, 't'||(p_partkey%700) AS target_id, 'raw/'||p_partkey AS source, sha256(p_name) AS source_sha256,
      'g'||(p_partkey%300%4) AS graph_sha256 FROM part),
    o AS (SELECT DISTINCT bundle_key, target_id, substr(bundle_key,2)::INT AS b, substr(target_id,2)::INT AS t FROM r WHERE substr(target_id,2)::INT%3=0),
    c AS (SELECT bundle_key, target_id, count(*) AS n FROM r GROUP BY 1,2),
    q AS (SELECT *, CASE WHEN n<>1 THEN 'ambiguous_override' WHEN b%23=0 THEN 'bundle_missing' WHEN b%19=0 THEN 'bundle_changed' WHEN b%4=3 THEN 'graph_changed'
      WHEN t%17=0 THEN 'image_missing' WHEN t%13=0 AND t%2=0 THEN 'image_changed' ELSE 'verified_override' END AS state FROM o JOIN c USING (bundle_key, target_id))
    SELECT r.bundle_key, r.target_id, CASE WHEN state='verified_override' THEN 'over/'||r.target_id ELSE source END AS source,
    CASE WHEN state='verified_override' THEN sha256(r.target_id||CASE WHEN t%13=0 THEN 'x' ELSE '' END) ELSE source_sha256 END AS source_sha256, coalesce(state, 'original') AS origin
    FROM r LEFT JOIN q USING (bundle_key, target_id)""",
)
def overrides(t):
    p = F.col("p_partkey")
    records = t.part.select(
        F.concat(F.lit("b"), p % 300).alias("bundle_key"), F.concat(F.lit("t"), p % 700).alias("target_id"),
        F.concat(F.lit("raw/"), p).alias("source"), F.sha2("p_name", 256).alias("source_sha256"),
        F.concat(F.lit("g"), p % 300 % 4).alias("graph_sha256"),
    )
    bundle, target = F.substring("bundle_key", 2, 10).cast("int"), F.substring("target_id", 2, 10).cast("int")
    chosen = records.filter(target % 3 == 0).select("bundle_key", "target_id").distinct()
    over = chosen.select(
        "bundle_key", "target_id", F.concat(F.lit("over/"), "target_id").alias("source"), F.concat(F.lit("file/"), "bundle_key").alias("path"),
        F.sha2("bundle_key", 256).alias("sha256"), F.when(target % 2 == 0, F.sha2("target_id", 256)).alias("image_sha256"),
        F.when(bundle % 4 == 3, "g").otherwise(F.concat(F.lit("g"), bundle % 4)).alias("graph_sha256"),
    )
    files = records.select("bundle_key").distinct().filter(bundle % 23 != 0)
    bundles = files.select(
        F.concat(F.lit("file/"), "bundle_key").alias("path"),
        F.sha2(F.concat("bundle_key", F.when(bundle % 19 == 0, "x").otherwise("")), 256).alias("sha256"),
    )
    images = records.select("target_id").distinct().filter(target % 17 != 0).select(
        F.concat(F.lit("over/"), "target_id").alias("source"),
        F.sha2(F.concat("target_id", F.when(target % 13 == 0, "x").otherwise("")), 256).alias("sha256"),
    )
    return graph.apply_overrides(records, over, bundles, images)


@GRAPH.query(
    "j34_owner_files",
    """WITH m AS (SELECT o_orderkey AS material, 'b'||(o_custkey%60) AS bundle_key, CASE WHEN o_orderkey%2=0 THEN 'own' END AS assets_file FROM orders),
    r AS (SELECT 'b'||(p_partkey%80) AS bundle_key, CASE WHEN p_partkey%80<40 THEN 'cab0' ELSE 'cab'||(p_partkey%3) END AS f FROM part),
    o AS (SELECT bundle_key, CASE WHEN count(DISTINCT f)=1 THEN min(f) END AS one FROM r GROUP BY 1)
    SELECT material, bundle_key, assets_file, coalesce(assets_file, one) AS owner_file, coalesce(assets_file, one) IS NOT NULL AS restorable FROM m LEFT JOIN o USING (bundle_key)""",
)
def owner_files(t):
    materials = t.orders.select(
        F.col("o_orderkey").alias("material"), F.concat(F.lit("b"), F.col("o_custkey") % 60).alias("bundle_key"),
        F.when(F.col("o_orderkey") % 2 == 0, "own").alias("assets_file"),
    )
    p = F.col("p_partkey")
    records = t.part.select(
        F.concat(F.lit("b"), p % 80).alias("bundle_key"),
        F.when(p % 80 < 40, F.lit("cab0")).otherwise(F.concat(F.lit("cab"), p % 3)).alias("assets_file"),
    )
    return graph.restore_owner_files(materials, records)


@GRAPH.query(
    "j35_projection_contracts",
    f"""WITH a AS (SELECT DISTINCT bundle_key, material_path_id, texture_bundle_key AS map_bundle, path_id AS map_path_id FROM slots WHERE property IN {_AUX} AND path_id<>0),
    d AS (SELECT s.bundle_key, s.material_path_id, bool_and(t.target_id IS NOT NULL) AS all_target, min({{'a':scale_u,'b':scale_v,'c':offset_u,'d':offset_v}}) AS lo,
      max({{'a':scale_u,'b':scale_v,'c':offset_u,'d':offset_v}}) AS hi FROM slots s LEFT JOIN targets t USING (texture_bundle_key, path_id) WHERE property IN {_DIFF} GROUP BY 1,2)
    SELECT map_bundle, map_path_id, bool_and(coalesce(all_target,false)) AS all_diffuse_targets, min(lo)=max(hi) AS single_transform, count(*) AS materials
    FROM a LEFT JOIN d USING (bundle_key, material_path_id) GROUP BY 1,2""",
    "slots targets",
)
def projection_contracts(t):
    return graph.projection_contracts(t.slots, t.targets)


@GRAPH.query(
    "a51_path_id_collisions",
    """SELECT bundle_key, path_id FROM (SELECT bundle_key, path_id%50 AS path_id, 'cab'||((path_id//50)%4) AS f FROM texture_names) GROUP BY 1,2 HAVING count(DISTINCT f)>1""",
    "texture_names",
)
def collisions(t):
    rows = t.texture_names.select(
        "bundle_key", (F.col("path_id") % 50).alias("path_id"), F.concat(F.lit("cab"), div(F.col("path_id"), 50) % 4).alias("assets_file")
    )
    return graph.path_id_collisions(rows)


@GRAPH.query(
    "a55_exactly_one",
    "SELECT texture_bundle_key, path_id, count(*) AS n FROM slots GROUP BY 1,2 HAVING count(*)<>1",
    "slots",
)
def exactly_one(t):
    return graph.exactly_one(t.slots, graph.TEXTURE)


@GRAPH.query(
    "f22_canonical_pairs",
    """SELECT l_orderkey, CASE WHEN v=0 THEN 0.0::DOUBLE ELSE v END AS value, NOT (isnan(v) OR isinf(v)) AS finite
    FROM (SELECT l_orderkey, CASE WHEN l_linenumber=3 THEN 'NaN'::DOUBLE WHEN l_linenumber=4 THEN 'Infinity'::DOUBLE ELSE -l_tax END AS v FROM lineitem)
    WHERE NOT (isnan(v) OR isinf(v))""",
)
def canonical_pairs(t):
    n = F.col("l_linenumber")
    raw = F.when(n == 3, F.lit(float("nan"))).when(n == 4, F.lit(float("inf"))).otherwise(-F.col("l_tax"))
    rows = t.lineitem.select("l_orderkey", raw.alias("v"))
    return rows.select(
        "l_orderkey", graph.canonical_zero(F.col("v")).alias("value"), graph.finite(F.col("v")).alias("finite")
    ).filter("finite")


@GRAPH.query(
    "p20_uv_projection",
    """WITH s AS (SELECT l_orderkey, l_linenumber, 1.0::DOUBLE+l_discount AS su, l_tax AS ou, 1.0::DOUBLE+CASE WHEN l_suppkey%4=0 THEN 0 ELSE l_discount END AS asu, l_partkey%6 AS w,
      l_quantity AS q, l_discount, l_tax FROM lineitem)
    SELECT l_orderkey, CASE WHEN q=7 THEN 'not_finite' WHEN q=8 THEN 'scale_not_positive' WHEN su<>asu THEN 'transform_differs' WHEN w=0 THEN 'wrap_not_repeat' END AS reason FROM s""",
)
def uv_projection(t):
    one = F.lit(1.0)
    q = F.col("l_quantity")
    scale = F.when(q == 7, F.lit(float("nan"))).when(q == 8, F.lit(0.0)).otherwise(one + F.col("l_discount"))
    aux = F.when(F.col("l_suppkey") % 4 == 0, one).otherwise(one + F.col("l_discount"))
    d = {"scale_u": scale, "scale_v": one, "offset_u": F.col("l_tax"), "offset_v": F.lit(0.0)}
    a = {**d, "scale_u": aux}
    wrap = F.when(F.col("l_partkey") % 6 == 0, 1).otherwise(0)
    return t.lineitem.select("l_orderkey", graph.same_uv_projection(d, a, wrap, F.lit(0)).alias("reason"))


@GRAPH.query(
    "p21_safe_keys",
    """SELECT page_id, NOT (regexp_matches(k,'^[A-Za-z]:') OR regexp_matches(k,'^[\\\\/]') OR regexp_matches(k,'(^|[\\\\/])\\.\\.([\\\\/]|$)')) AND k<>'' AS safe
    FROM (SELECT page_id, CASE page_id%4 WHEN 0 THEN substr(url, 8) WHEN 1 THEN '/'||url WHEN 2 THEN replace(url,'example','..') ELSE 'a/../'||page_id END AS k FROM pages)""",
)
def safe_keys(t):
    p = F.col("page_id") % 4
    key = (
        F.when(p == 0, F.substring("url", F.lit(8), F.length("url")))
        .when(p == 1, F.concat(F.lit("/"), "url"))
        .when(p == 2, F.replace("url", F.lit("example"), F.lit("..")))
        .otherwise(F.concat(F.lit("a/../"), "page_id"))
    )
    return t.pages.select("page_id", graph.safe_key(key).alias("safe"))
