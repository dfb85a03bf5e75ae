"""Hash-tree digests of groups, bundles and bindings."""

import hashlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from assetspark.functions.ids import sha256_hex, tree_digest
from assetspark.operators import graph

SLOT = (
    "bundle_key string, assets_file string, material_path_id long, property string, file_id int, path_id long, external_assets_file string, "
    "texture_bundle_key string, scale_u double, scale_v double, offset_u double, offset_v double"
)
MATERIAL = "bundle_key string, assets_file string, material_path_id long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_tree(hashes):
    buckets = defaultdict(list)
    for h in hashes:
        buckets[h[:4]].append(h)
    leaves = [sha(",".join(sorted(buckets[b]))) for b in sorted(buckets)]
    return sha(f"{len(hashes)}:" + ",".join(leaves))


def test_tree_equals_the_plain_tree(spark):
    rows = [("a", str(i % 700)) for i in range(3000)] + [("b", "x"), ("b", "x"), ("c", None), (None, "y")]
    df = spark.createDataFrame(rows, "k string, v string")
    got = {r.k: r for r in tree_digest(df, ["k"], sha256_hex(F.col("v")), short=F.length("v") < 3).collect()}
    groups = defaultdict(list)
    for k, v in rows:
        if v is not None:
            groups[k].append(v)
    assert {k: (r.digest, r.n, r.short) for k, r in got.items()} == {
        k: (plain_tree([sha(v) for v in vs]), len(vs), sum(len(v) < 3 for v in vs)) for k, vs in groups.items()
    }
    again = {r.k: r.digest for r in tree_digest(df.repartition(5).orderBy(F.desc("v")), ["k"], sha256_hex(F.col("v"))).collect()}
    assert again == {k: r.digest for k, r in got.items()}
    whole = tree_digest(df, [], sha256_hex(F.col("v"))).collect()
    assert [(r.digest, r.n) for r in whole] == [(plain_tree([sha(v) for _, v in rows if v is not None]), 3003)]
    assert [(r.digest, r.n) for r in tree_digest(df.limit(0), [], sha256_hex(F.col("v"))).collect()] == [(plain_tree([]), 0)]
    assert tree_digest(df.limit(0), ["k"], sha256_hex(F.col("v"))).count() == 0


def slot(bundle="b", file="f1", material=1, prop="_MainTex", file_id=0, path=7, outside=None, scale=1.0, offset=0.0):
    return (bundle, file, material, prop, file_id, path, outside, "tex", scale, 1.0, offset, 0.0)


def digest(spark, slots, materials):
    rows = graph.graph_digests(spark.createDataFrame(slots, SLOT), spark.createDataFrame(materials, MATERIAL)).collect()
    assert len(rows) == 1
    return tuple(rows[0])[1:]


def test_graph_identity(spark):
    both = [("b", "f1", 1), ("b", "f2", 1)]
    base = digest(spark, [slot(), slot(prop="_BumpMap")], both)
    assert base[1:] == (2, 2)
    assert digest(spark, [slot(prop="_BumpMap"), slot()], both[::-1] + both) == base  # order and repeated materials
    assert digest(spark, [slot(offset=-0.0), slot(prop="_BumpMap")], both) == base
    changed = [
        digest(spark, [slot(file="f2"), slot(prop="_BumpMap")], both),  # moved to another file
        digest(spark, [slot(material=2), slot(prop="_BumpMap")], both),
        digest(spark, [slot(file_id=1), slot(prop="_BumpMap")], both),
        digest(spark, [slot(outside="x"), slot(prop="_BumpMap")], both),
        digest(spark, [slot(scale=1.0000001), slot(prop="_BumpMap")], both),
        digest(spark, [slot(), slot(), slot(prop="_BumpMap")], both),  # a slot more
        digest(spark, [slot(), slot(prop="_BumpMap")], [*both, ("b", "f3", 9)]),  # a material without slots
        digest(spark, [slot(), slot(prop="_BumpMap")], both[:1]),
    ]
    assert len({base[0], *[c[0] for c in changed]}) == 1 + len(changed)
    assert changed[6][1:] == (3, 2)


def test_binding_signature_follows_the_pointer(spark):
    targets = spark.createDataFrame([("tex", 7, "t")], "texture_bundle_key string, path_id long, target_id string")

    def signature(*slots):
        return [tuple(r) for r in graph.binding_signatures(spark.createDataFrame(list(slots), SLOT), targets).collect()]

    base = signature(slot(), slot(prop="_BumpMap", path=8))
    assert base[0][0] == "t" and base[0][2] == 2
    assert signature(slot(prop="_BumpMap", path=8), slot()) == base
    assert signature(slot(), slot(prop="_BumpMap", path=8), slot(prop="_Detail", path=9)) == base  # no relevant slot
    assert signature(slot(file="f2"), slot(prop="_BumpMap", path=8)) != base
    assert Counter(len(s[0][1]) for s in (base,)) == {64: 1}
