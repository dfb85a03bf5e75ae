"""Dependency graph: slots, materials, renderers, bundles, digests.

Tables: ``slots`` (bundle_key, material_path_id, property, texture_bundle_key,
path_id, scale_u, scale_v, offset_u, offset_v), ``targets``
(texture_bundle_key, path_id, target_id), ``deps`` (bundle_key, depends_on).
Sets of targets stay rows; nothing collects a material's or bundle's members.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arithmetic import count_where
from ..functions.ids import field_text, sha256_hex, tree_digest

# Shader property names by role.
DIFFUSE = ["_MainTex", "_BaseMap", "_BaseColorMap"]
NORMAL = ["_BumpMap", "_NormalMap"]
GLOSS = ["_SpecMap", "_GlossMap", "_MetallicGlossMap"]

MATERIAL = ["bundle_key", "material_path_id"]
TEXTURE = ["texture_bundle_key", "path_id"]
TRANSFORM = ["scale_u", "scale_v", "offset_u", "offset_v"]


def auxiliary_role(prop: Column) -> Column:
    return F.when(prop.isin(NORMAL), "normal").when(prop.isin(GLOSS), "gloss")


def canonical_zero(value: Column) -> Column:
    """-0.0 becomes 0.0 so that equal transforms hash alike."""
    return F.when(value == 0, F.lit(0.0)).otherwise(value)


def finite(*values: Column) -> Column:
    out = F.lit(True)
    for v in values:
        out = out & v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))
    return out


def exactly_one(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of a lookup table that do not occur exactly once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n <> 1")


# ---- targets and dependencies ---------------------------------------------


def match_targets(textures: DataFrame, specs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Texture rows with their target; a spec without a bundle matches any.

    Both kinds of spec are equi-joins. Returns matches and ambiguous textures.
    """
    bound = specs.filter("bundle_key is not null")
    free = specs.filter("bundle_key is null").drop("bundle_key")
    hits = textures.join(bound, ["texture", "bundle_key"]).unionByName(textures.join(free, "texture"))
    per = hits.groupBy("texture", "bundle_key").agg(
        F.count_distinct("target_id").alias("n"), F.min("target_id").alias("target_id")
    )
    return per.filter("n = 1").drop("n"), per.filter("n > 1").drop("target_id")


def reverse_dependencies(deps: DataFrame) -> DataFrame:
    """(texture_bundle_key, dependent): who depends on a bundle, itself excluded."""
    return deps.filter("bundle_key <> depends_on").select(
        F.col("depends_on").alias("texture_bundle_key"), F.col("bundle_key").alias("dependent")
    ).distinct()


def resolve_slots(slots: DataFrame, externals: DataFrame, textures: DataFrame) -> DataFrame:
    """Texture behind each slot pointer.

    ``slots``: slot_id, bundle_key, file_id, path_id, external_file. A local
    pointer (file_id 0) looks in its own bundle; an external one in the bundles
    of the named file, and counts only if exactly one of them owns the path id.
    ``externals``: file_name, owner_bundle; ``textures``: bundle_key, path_id, texture.
    """
    owned = textures.select(F.col("bundle_key").alias("owner"), F.col("path_id").alias("pid"), "texture")
    local = slots.filter("file_id = 0").join(
        owned, (F.col("bundle_key") == F.col("owner")) & (F.col("path_id") == F.col("pid")), "left"
    )
    files = externals.select(F.lower("file_name").alias("low"), F.col("owner_bundle").alias("owner")).distinct()
    # path ids resolve before slots are joined, so a hot texture stays one row
    by_file = files.join(owned, "owner").groupBy("low", "pid").agg(
        F.count("*").alias("owners"), F.min("owner").alias("owner"), F.min("texture").alias("texture")
    ).filter("owners = 1").drop("owners")
    outside = slots.filter("file_id <> 0").join(
        by_file, (F.lower("external_file") == F.col("low")) & (F.col("path_id") == F.col("pid")), "left"
    ).drop("low")
    return local.unionByName(outside).drop("pid").withColumnRenamed("owner", "texture_bundle_key")


def material_targets(slots: DataFrame, targets: DataFrame) -> DataFrame:
    """(material, target_id) through main-texture properties only."""
    main = slots.filter(F.col("property").isin(DIFFUSE)).select(*MATERIAL, *TEXTURE).distinct()
    return main.join(targets, TEXTURE).select(*MATERIAL, "target_id").distinct()


def auxiliary_pointers(slots: DataFrame, targets: DataFrame) -> DataFrame:
    """Normal and gloss textures of materials that also consume a target."""
    owners = material_targets(slots, targets).select(*MATERIAL).distinct()
    aux = slots.filter(auxiliary_role(F.col("property")).isNotNull() & (F.col("path_id") != 0))
    return aux.join(owners, MATERIAL, "left_semi").select(*TEXTURE).distinct()


def external_materials(slots: DataFrame, targets: DataFrame, deps: DataFrame, known: DataFrame) -> DataFrame:
    """Materials outside the known set that are reachable in two hops.

    Hop 1: consumers of target diffuse maps in bundles that depend on them.
    Hop 2: every consumer of the auxiliary maps those materials (and the known
    ones) reach.
    """
    reverse = reverse_dependencies(deps)
    diffuse = slots.filter(F.col("property").isin(DIFFUSE)).select(*MATERIAL, *TEXTURE).distinct()

    def consumers(textures: DataFrame, rows: DataFrame) -> DataFrame:
        allowed = textures.join(reverse, "texture_bundle_key").withColumnRenamed("dependent", "bundle_key")
        return rows.join(allowed, [*TEXTURE, "bundle_key"], "left_semi").select(*MATERIAL).distinct()

    first = consumers(targets.select(*TEXTURE).distinct(), diffuse).join(known, MATERIAL, "left_anti")
    reached = first.unionByName(known.select(*MATERIAL)).distinct()
    pointers = (
        slots.filter(auxiliary_role(F.col("property")).isNotNull())
        .join(reached, MATERIAL, "left_semi")
        .join(material_targets(slots, targets).select(*MATERIAL).distinct(), MATERIAL, "left_semi")
        .select(*TEXTURE)
        .distinct()
    )
    aux_rows = slots.filter(auxiliary_role(F.col("property")).isNotNull()).select(*MATERIAL, *TEXTURE).distinct()
    second = consumers(pointers, aux_rows).join(reached, MATERIAL, "left_anti")
    return first.withColumn("hop", F.lit(1)).unionByName(second.withColumn("hop", F.lit(2)))


def unresolved_targets(targets: DataFrame, links: DataFrame, renderers: DataFrame) -> DataFrame:
    """Targets without a consuming material or without a renderer."""
    no_material = targets.join(links, "target_id", "left_anti").select("target_id", F.lit("no_material").alias("reason"))
    no_renderer = targets.join(links, "target_id", "left_semi").join(renderers, "target_id", "left_anti").select(
        "target_id", F.lit("no_renderer").alias("reason")
    )
    return no_material.unionByName(no_renderer).distinct()


def consumers_of(slots: DataFrame, textures: DataFrame) -> DataFrame:
    """Every slot, of any property, that uses one of the textures."""
    return slots.join(textures, TEXTURE).select(*textures.columns, *MATERIAL, "property", *TRANSFORM)


def target_bindings(slots: DataFrame, targets: DataFrame) -> DataFrame:
    """All slots of the materials bound to some target's diffuse map."""
    bound = material_targets(slots, targets).select(*MATERIAL).distinct()
    return slots.join(bound, MATERIAL, "left_semi")


def auxiliary_slots(slots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Assigned auxiliary slots with their role, and half-resolved ones.

    ``texture`` null together with no bundle and path 0 is an empty slot.
    """
    aux = slots.withColumn("role", auxiliary_role(F.col("property"))).filter("role is not null")
    has_path = F.coalesce(F.col("path_id"), F.lit(0)) != 0
    has_texture, has_bundle = F.col("texture").isNotNull(), F.col("texture_bundle_key").isNotNull()
    assigned = aux.filter(has_path | has_texture | has_bundle)
    whole = has_path & has_texture & has_bundle
    return assigned.filter(whole), assigned.filter(~whole)


def diffuse_beside_auxiliary(slots: DataFrame) -> DataFrame:
    """The single diffuse transform of each material with an auxiliary slot.

    ``ambiguous`` marks materials whose diffuse slots disagree.
    """
    transform = F.struct(*[canonical_zero(F.col(c)).alias(c) for c in TRANSFORM])
    diffuse = F.col("property").isin(DIFFUSE)
    per = slots.groupBy(*MATERIAL).agg(
        F.min(F.when(diffuse, transform)).alias("lo"),
        F.max(F.when(diffuse, transform)).alias("hi"),
        count_where(diffuse).alias("diffuse_slots"),
        count_where(auxiliary_role(F.col("property")).isNotNull()).alias("auxiliary_slots"),
    )
    return per.filter("auxiliary_slots > 0").select(
        *MATERIAL,
        "auxiliary_slots",
        "diffuse_slots",
        ((F.col("diffuse_slots") == 0) | (F.col("lo") != F.col("hi"))).alias("ambiguous"),
        F.col("lo.scale_u").alias("scale_u"),
        F.col("lo.offset_u").alias("offset_u"),
    )


UNMAPPED = "__unmapped_consumer__"


def consumer_closure(slots: DataFrame, targets: DataFrame, textures: DataFrame) -> DataFrame:
    """(texture, target_id): targets of all consumers of each texture.

    A material counts only if all its assigned diffuse slots are targets;
    otherwise the texture also gets the unmapped marker.
    """
    diffuse = slots.filter(F.col("property").isin(DIFFUSE) & (F.col("path_id") != 0)).select(*MATERIAL, *TEXTURE).distinct()
    mapped = diffuse.join(targets, TEXTURE, "left")
    closed = mapped.groupBy(*MATERIAL).agg(F.bool_and(F.col("target_id").isNotNull()).alias("closed"))
    members = mapped.join(closed.filter("closed"), MATERIAL, "left_semi").select(*MATERIAL, "target_id").distinct()
    users = slots.join(textures, TEXTURE, "left_semi").select(*TEXTURE, *MATERIAL).distinct()
    found = users.join(members, MATERIAL, "left")
    return found.select(*TEXTURE, F.coalesce("target_id", F.lit(UNMAPPED)).alias("target_id")).distinct()


# ---- renderers ------------------------------------------------------------


def submesh_targets(renderers: DataFrame, material_slots: DataFrame, links: DataFrame) -> DataFrame:
    """(renderer_id, submesh, target_id): submesh i draws material min(i, n-1)."""
    sized = material_slots.groupBy("renderer_id").agg(F.count("*").alias("n_slots"))
    parts = (
        renderers.join(sized, "renderer_id")
        .withColumn("submesh", F.explode(F.sequence(F.lit(0), F.col("submesh_count") - 1)))
        .withColumn("slot", F.least(F.col("submesh"), F.col("n_slots") - 1).cast("long"))
    )
    return (
        parts.join(material_slots, ["renderer_id", "slot"])
        .join(links, MATERIAL)
        .select("renderer_id", "submesh", "target_id")
        .distinct()
    )


def spread_materials(links: DataFrame, deps: DataFrame) -> DataFrame:
    """Bundles whose renderers may use a material: its own and its dependents."""
    own = links.select(*MATERIAL, F.col("bundle_key").alias("renderer_bundle"), "target_id")
    reverse = reverse_dependencies(deps).withColumnRenamed("texture_bundle_key", "bundle_key")
    wider = links.join(reverse, "bundle_key").select(*MATERIAL, F.col("dependent").alias("renderer_bundle"), "target_id")
    return own.unionByName(wider).distinct()


def conflicting_identities(target_sets: DataFrame, identity: list[str], source: str) -> DataFrame:
    """Identities whose target set differs between sources.

    Each source's set is reduced to a digest, so sets are compared by value.
    """
    digests = tree_digest(target_sets.distinct(), [*identity, source], sha256_hex(F.col("target_id")))
    return digests.groupBy(*identity).agg(F.count_distinct("digest").alias("variants")).filter("variants > 1")


# ---- digests and conflicts ------------------------------------------------


#: What names a material and what a slot points at, before names are resolved.
OWNER = ["assets_file", "material_path_id"]
POINTER = ["property", "file_id", "path_id", "external_assets_file"]


def slot_hash(*more: Column) -> Column:
    """Hash of one slot: its material's file and id, the raw pointer and the exact transforms; names are left out."""
    fields = [F.col(c) for c in [*OWNER, *POINTER]] + [canonical_zero(F.col(c)) for c in TRANSFORM]
    return sha256_hex(F.concat(F.lit("slot"), field_text(*more, *fields)))


def graph_digests(slots: DataFrame, materials: DataFrame) -> DataFrame:
    """Order-independent digest, material count and slot count per bundle.

    ``materials``: bundle_key, assets_file, material_path_id, also of materials without slots; repeated ones count once.
    ``slots``: the same with property, file_id, path_id, external_assets_file and the transforms; repeated slots count.
    """
    named = materials.select("bundle_key", *OWNER).distinct()
    rows = slots.select("bundle_key", slot_hash().alias("h"), F.lit(False).alias("whole")).unionByName(
        named.select("bundle_key", sha256_hex(F.concat(F.lit("material"), field_text(*map(F.col, OWNER)))).alias("h"), F.lit(True).alias("whole"))
    )
    whole = F.col("whole")
    return tree_digest(rows, ["bundle_key"], F.col("h"), "graph_sha256", material_count=whole, texture_slot_count=~whole).drop("n")


def binding_signatures(slots: DataFrame, targets: DataFrame) -> DataFrame:
    """Digest per target over all relevant slots of its bound materials."""
    links = material_targets(slots, targets)
    relevant = slots.filter(F.col("property").isin(DIFFUSE + NORMAL + GLOSS) & (F.col("path_id") != 0))
    hashed = relevant.withColumn("h", slot_hash(F.col("bundle_key")))
    return tree_digest(hashed.join(links, MATERIAL), ["target_id"], F.col("h"), "signature").withColumnRenamed("n", "slots")


def contract_conflicts(slots: DataFrame) -> DataFrame:
    """Contract keys with several maps or transforms, and two-role textures."""
    aux = slots.withColumn("role", auxiliary_role(F.col("property"))).filter("role is not null")
    whole = F.struct("role", *TEXTURE, *[canonical_zero(F.col(c)).alias(c) for c in TRANSFORM])
    keys = aux.groupBy(*MATERIAL, "property").agg(F.min(whole).alias("lo"), F.max(whole).alias("hi")).filter("lo <> hi")
    roles = aux.groupBy(*TEXTURE).agg(F.min("role").alias("lo"), F.max("role").alias("hi")).filter("lo <> hi")
    return keys.select(
        F.lit("contract").alias("kind"),
        F.concat_ws("::", *MATERIAL, "property").alias("conflict_key"),
    ).unionByName(
        roles.select(F.lit("two_roles").alias("kind"), F.concat_ws("::", *TEXTURE).alias("conflict_key"))
    )


def merge_plans(plans: DataFrame) -> DataFrame:
    """One plan per shared map: signature spread and number of targets.

    ``plans``: texture_bundle_key, path_id, role, target_id, signature.
    """
    return plans.groupBy(*TEXTURE, "role").agg(
        F.min("signature").alias("signature"),
        (F.min("signature") == F.max("signature")).alias("agreed"),
        F.count_distinct("target_id").alias("targets"),
    )


def path_id_collisions(textures: DataFrame) -> DataFrame:
    """Path ids that occur in several files of one bundle."""
    return textures.groupBy("bundle_key", "path_id").agg(
        F.min("assets_file").alias("lo"), F.max("assets_file").alias("hi")
    ).filter("lo <> hi").select("bundle_key", "path_id")


def dependency_snapshot(slots: DataFrame, targets: DataFrame, deps: DataFrame, hashes: DataFrame) -> DataFrame:
    """Rows (kind, bundle_key, dependent, sha256) of the dependency state."""
    reverse = reverse_dependencies(deps)
    observed = targets.select("texture_bundle_key").unionByName(
        auxiliary_pointers(slots, targets).select("texture_bundle_key")
    ).distinct()
    material_bundles = material_targets(slots, targets).select(F.col("bundle_key").alias("texture_bundle_key")).distinct()

    def rows(kind: str, wanted: DataFrame) -> DataFrame:
        return reverse.join(wanted, "texture_bundle_key", "left_semi").select(
            F.lit(kind).alias("kind"), F.col("texture_bundle_key").alias("bundle_key"), "dependent"
        )

    listed = rows("reverse", observed).unionByName(rows("renderer", material_bundles))
    named = hashes.select(F.col("bundle_key").alias("dependent"), "sha256")
    return listed.join(named, "dependent", "left")


def snapshot_drift(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """Rows that differ: catalog changes (membership) or changed bundles (hash)."""
    keys = ["kind", "bundle_key", "dependent"]
    old = recorded.select(*keys, F.col("sha256").alias("old_sha256"), F.lit(1).alias("_o"))
    new = current.select(*keys, F.col("sha256").alias("new_sha256"), F.lit(1).alias("_n"))
    joined = old.join(new, keys, "full")
    drift = F.when(F.col("_o").isNull() | F.col("_n").isNull(), "catalog_changed").when(
        ~F.col("old_sha256").eqNullSafe(F.col("new_sha256")), "bundle_changed"
    )
    return joined.withColumn("drift", drift).filter("drift is not null").select(*keys, "drift")


def hash_pins(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """State of each recorded artifact: ok, changed or missing."""
    live = current.select("path", F.col("sha256").alias("live"))
    state = F.when(F.col("live").isNull(), "missing").when(F.col("live") == F.col("sha256"), "ok").otherwise("changed")
    return recorded.join(live, "path", "left").withColumn("state", state).drop("live")


def deployment_rows(wanted: DataFrame, deps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bundle_key, depends_on) of the wanted keys, and keys the catalog lacks."""
    keys = wanted.select("bundle_key").distinct()
    known = deps.select("bundle_key", "depends_on").distinct()
    return known.join(keys, "bundle_key", "left_semi"), keys.join(known, "bundle_key", "left_anti")


def source_bundles(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """Check that a bundle has one recorded hash and that it is the current one."""
    one = recorded.groupBy("bundle_key").agg(F.min("sha256").alias("lo"), F.max("sha256").alias("hi"))
    joined = one.join(current.select("bundle_key", F.col("sha256").alias("live")), "bundle_key", "left")
    state = (
        F.when(F.col("lo") != F.col("hi"), "several_hashes")
        .when(F.col("live").isNull(), "missing")
        .when(F.col("live") == F.col("lo"), "ok")
        .otherwise("changed")
    )
    return joined.select("bundle_key", state.alias("state"))


def apply_overrides(records: DataFrame, overrides: DataFrame, bundles: DataFrame, images: DataFrame) -> DataFrame:
    """Overlay verified source overrides.

    ``records``: bundle_key, target_id, source, source_sha256, graph_sha256; ``overrides``: bundle_key, target_id, source,
    path and sha256 of its bundle, image_sha256 (null: not pinned), graph_sha256; ``bundles``: path, sha256 and
    ``images``: source, sha256 of the files as they are now, one row each. An override applies only if it is the only one of its
    target, matches exactly one record, and bundle, graph and image are what was verified; otherwise the record stays as it is.
    ``origin`` names the first thing that failed. The image's present hash becomes the record's.
    """
    key = ["bundle_key", "target_id"]
    fields = ["source", "path", "sha256", "image_sha256", "graph_sha256"]
    counted = records.groupBy(*key).agg(F.count("*").alias("matches"))
    over = overrides.groupBy(*key).agg(F.count("*").alias("overrides"), *[F.min(c).alias(f"o_{c}") for c in fields])
    over = over.join(bundles.select(F.col("path").alias("o_path"), F.col("sha256").alias("bundle_now")), "o_path", "left")
    over = over.join(images.select(F.col("source").alias("o_source"), F.col("sha256").alias("image_now")), "o_source", "left")
    joined = records.join(over.join(counted, key), key, "left")
    pinned = F.coalesce("o_image_sha256", "image_now")
    origin = (
        F.when(F.col("overrides").isNull(), "original")
        .when((F.col("matches") != 1) | (F.col("overrides") != 1), "ambiguous_override")
        .when(F.col("bundle_now").isNull(), "bundle_missing")
        .when(~F.col("bundle_now").eqNullSafe(F.col("o_sha256")), "bundle_changed")
        .when(~F.col("o_graph_sha256").eqNullSafe(F.col("graph_sha256")), "graph_changed")
        .when(F.col("image_now").isNull(), "image_missing")
        .when(pinned != F.col("image_now"), "image_changed")
        .otherwise("verified_override")
    )
    valid = F.col("origin") == "verified_override"
    return joined.withColumn("origin", origin).select(
        *key,
        F.when(valid, F.col("o_source")).otherwise(F.col("source")).alias("source"),
        F.when(valid, F.col("image_now")).otherwise(F.col("source_sha256")).alias("source_sha256"),
        "origin",
    )


def restore_owner_files(materials: DataFrame, records: DataFrame) -> DataFrame:
    """Fill a missing assets_file when the bundle's records name exactly one."""
    owner = records.filter("assets_file <> ''").groupBy("bundle_key").agg(
        F.min("assets_file").alias("lo"), F.max("assets_file").alias("hi")
    )
    joined = materials.join(owner, "bundle_key", "left")
    one = F.when(F.col("lo") == F.col("hi"), F.col("lo"))
    return joined.withColumn("owner_file", F.coalesce("assets_file", one)).withColumn(
        "restorable", F.col("owner_file").isNotNull()
    ).drop("lo", "hi")


def projection_contracts(slots: DataFrame, targets: DataFrame) -> DataFrame:
    """Per auxiliary map: all diffuse slots beside it belong to targets and share one transform."""
    aux = slots.filter(auxiliary_role(F.col("property")).isNotNull() & (F.col("path_id") != 0)).select(
        *MATERIAL, F.col("texture_bundle_key").alias("map_bundle"), F.col("path_id").alias("map_path_id")
    ).distinct()
    diffuse = slots.filter(F.col("property").isin(DIFFUSE))
    transform = F.struct(*[canonical_zero(F.col(c)).alias(c) for c in TRANSFORM])
    marked = diffuse.join(targets, TEXTURE, "left")
    # one row per material before the maps are joined
    per_material = marked.groupBy(*MATERIAL).agg(
        F.bool_and(F.col("target_id").isNotNull()).alias("all_target"),
        F.min(transform).alias("lo"),
        F.max(transform).alias("hi"),
    )
    return aux.join(per_material, MATERIAL, "left").groupBy("map_bundle", "map_path_id").agg(
        F.bool_and(F.coalesce("all_target", F.lit(False))).alias("all_diffuse_targets"),
        (F.min("lo") == F.max("hi")).alias("single_transform"),
        F.count("*").alias("materials"),
    )


def same_uv_projection(d: dict[str, Column], a: dict[str, Column], wrap_u: Column, wrap_v: Column) -> Column:
    """Reason why a diffuse/auxiliary pair cannot share a projection, or null."""
    values = [d[c] for c in TRANSFORM] + [a[c] for c in TRANSFORM]
    same = F.lit(True)
    for c in TRANSFORM:
        same = same & (d[c] == a[c])
    return (
        F.when(~finite(*values), "not_finite")
        .when((d["scale_u"] <= 0) | (d["scale_v"] <= 0), "scale_not_positive")
        .when(~same, "transform_differs")
        .when((wrap_u != 0) | (wrap_v != 0), "wrap_not_repeat")
    )


def safe_key(key: Column) -> Column:
    """Relative key without drive, absolute root or parent steps."""
    return (key != "") & ~key.rlike(r"^[A-Za-z]:") & ~key.rlike(r"^[\\/]") & ~key.rlike(r"(^|[\\/])\.\.([\\/]|$)")
