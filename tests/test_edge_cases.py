"""Answers that the given tables do not reach: blanks, nulls, far coordinates, file kinds, early stops."""

import json

from pyspark.sql import functions as F

from assetspark.functions import ids, text
from assetspark.operators import graph, recognizer, selection, texels
from assetspark.sources import manifests


def test_unicode_blanks_are_blank(spark):
    df = spark.createDataFrame([("　",), ("\x85  ",), ("",), (" a　",), (None,)], "t string")
    assert [r.b for r in df.select(text.is_blank(F.col("t")).alias("b")).collect()] == [True, True, True, False, None]
    assert df.select(text.short_text(F.col("t")).alias("s")).collect()[3].s == "a"
    seen = spark.createDataFrame([(1, 0, "e", "v", "　", 0.9)], "asset_id long, seq long, engine string, variant string, text string, confidence double")
    row = selection.classify(seen).first()
    assert (row.tier, row.reason_codes) == ("needs_review", "detector_only")


def test_component_is_composed_first(spark):
    df = spark.createDataFrame([("é.png",)], "n string")
    assert df.select(ids.sanitize_component(F.col("n"), F.lit("id")).alias("c")).first().c.startswith("é")


def test_slot_hash_keeps_nulls_and_small_differences(spark):
    schema = "assets_file string, material_path_id long, property string, file_id int, path_id long, external_assets_file string, scale_u double, scale_v double, offset_u double, offset_v double"
    rows = [
        ("f", 1, None, 0, 2, "q", 1.0, 1.0, 0.0, 0.0), ("f", 1, "q", 0, 2, None, 1.0, 1.0, 0.0, 0.0), ("f", 1, "q", 0, 2, None, 1.0, 1.0, 0.0, -0.0),
        ("f", 1, "q", 0, 2, None, 1.0 + 1e-12, 1.0, 0.0, 0.0),
    ]
    a, b, c, d = [r.h for r in spark.createDataFrame(rows, schema).select(graph.slot_hash().alias("h")).collect()]
    assert b == c and len({a, b, d}) == 3 and None not in (a, b, d)


def test_two_overrides_of_one_target_leave_the_record(spark):
    records = spark.createDataFrame([("b", t, "raw", "s", "g") for t in "xyz"], "bundle_key string, target_id string, source string, source_sha256 string, graph_sha256 string")
    columns = "bundle_key string, target_id string, source string, path string, sha256 string, image_sha256 string, graph_sha256 string"
    rows = [("b", t, o, "f", "h", None, "g") for t, o in (("x", "o1"), ("x", "o2"), ("y", "o3"))]
    bundles = spark.createDataFrame([("f", "h")], "path string, sha256 string")
    images = spark.createDataFrame([("o3", "i3")], "source string, sha256 string")
    got = sorted(tuple(r)[1:] for r in graph.apply_overrides(records, spark.createDataFrame(rows, columns), bundles, images).collect())
    assert got == [("x", "raw", "s", "ambiguous_override"), ("y", "o3", "i3", "verified_override"), ("z", "raw", "s", "original")]

    def origin(path="f", sha="h", image=None, graph_hash="g", source="o3"):
        over = spark.createDataFrame([("b", "y", source, path, sha, image, graph_hash)], columns)
        return [r.origin for r in graph.apply_overrides(records, over, bundles, images).filter("target_id = 'y'").collect()]

    assert origin(image="i3") == ["verified_override"]
    assert origin(path="gone") == ["bundle_missing"] and origin(sha="x") == ["bundle_changed"] and origin(graph_hash="x") == ["graph_changed"]
    assert origin(source="gone") == ["image_missing"] and origin(image="x") == ["image_changed"]


def test_fill_reaches_far_texels_and_reports_uncovered_textures(spark):
    rows = [(1, 16390, 20000, True), (1, 16391, 20000, False), (1, 16390, 20001, False), (2, 0, 0, False)]
    df = spark.createDataFrame([(*r, 7) for r in rows], "texture_id long, x long, y long, covered boolean, r int")
    got = {(r.texture_id, r.x, r.y): (r.source_x, r.source_y, r.r, r.error) for r in texels.pad_outside(df, ["r"]).collect()}
    assert len(got) == 4 and got[(2, 0, 0)] == (None, None, None, "no_coverage")
    assert {v for k, v in got.items() if k[0] == 1} == {(16390, 20000, 7, None)}


def test_manifest_kind_decides_what_a_record_is(spark, tmp_path):
    whole = tmp_path / "m.json"
    whole.write_text('{"foo": 1}', encoding="utf-8")
    assert [(r.record, r.error) for r in manifests.read_manifest(spark, str(whole)).collect()] == [(None, "unsupported_manifest")]
    lines = tmp_path / "m.jsonl"
    lines.write_text(json.dumps({"image": "a", "assets": [{"image": "b"}]}) + '\n[{"image": "c"}]\n', encoding="utf-8")
    got = [(r.record and r.record["image"], r.error) for r in manifests.read_manifest(spark, str(lines)).collect()]
    assert sorted(got, key=str) == [("a", None), (None, "unsupported_manifest")]


def test_other_scripts_do_not_stop_the_recognizer(spark):
    assets = spark.createDataFrame([("a", bytearray(b"x"))], "asset_id string, payload binary")

    def engine(payload, variant):
        found = {"v0": ("한국어", 0.99), "v1": ("WARNING", 0.95)}[variant]
        return [{"text": found[0], "confidence": found[1]}]

    row = recognizer.scan_assets(assets, ("one", engine), None, ["v0", "v1"]).first()
    assert (row.variant_calls, row.tier) == (2, "confirmed")
