import hashlib
import json
import struct
import zlib

from pyspark.sql import functions as F

from assetspark.operators import recognizer, selection
from assetspark.sources import images, manifests, sinks


def png(width, height, kind, pixels):
    """Minimal 8-bit PNG: kind 0 gray, 2 RGB, 6 RGBA."""
    size = {0: 1, 2: 3, 6: 4}[kind]
    lines = b"".join(b"\0" + pixels[y * width * size : (y + 1) * width * size] for y in range(height))

    def chunk(name, body):
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    head = struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def test_pictures_hashes_and_texels(spark, tmp_path):
    rgb = bytes(range(18))
    rgba = b"".join(rgb[i : i + 3] + b"\xff" for i in range(0, 18, 3))
    (tmp_path / "sub").mkdir()
    (tmp_path / "rgb.png").write_bytes(png(3, 2, 2, rgb))
    (tmp_path / "sub" / "RGBA.PNG").write_bytes(png(3, 2, 6, rgba))
    (tmp_path / "gray.png").write_bytes(png(2, 1, 0, b"\x05\x09"))
    (tmp_path / "bad.png").write_bytes(b"not an image")
    (tmp_path / "note.txt").write_text("x")
    folder = str(tmp_path)
    assert sorted(r.path.rsplit("/", 1)[1] for r in images.listing(spark, folder).collect()) == ["RGBA.PNG", "bad.png", "gray.png", "rgb.png"]
    hashes = {r.path.rsplit("/", 1)[1]: r.sha256 for r in images.content_hashes(spark, folder).collect()}
    assert hashes["note.txt"] == hashlib.sha256(b"x").hexdigest()

    (tmp_path / "note.txt").unlink()
    decoded = images.pictures(spark, folder)
    prints = {r.path.rsplit("/", 1)[1]: r for r in images.fingerprints(decoded).collect()}
    want = hashlib.sha256(b"RGBA:3x2\0" + rgba).hexdigest()
    assert prints["rgb.png"].pixel_sha256 == prints["RGBA.PNG"].pixel_sha256 == want
    assert prints["bad.png"].error == "decode_failed" and prints["bad.png"].pixel_sha256 is None

    named = decoded.filter("error is null").withColumn("texture_id", F.regexp_extract("path", "[^/]+$", 0))
    rows = {(r.texture_id, r.x, r.y): (r.r, r.g, r.b, r.a) for r in images.explode_texels(named).collect()}
    assert rows[("rgb.png", 1, 0)] == (3, 4, 5, 255) and rows[("RGBA.PNG", 2, 1)] == (15, 16, 17, 255)
    assert rows[("gray.png", 1, 0)] == (9, 9, 9, 255)


def test_manifest_shapes(spark, tmp_path):
    one = tmp_path / "m.jsonl"
    one.write_text('{"png": "a.png", "key": "k"}\n\n[1, 2]\n{"image": "b.png"}\n', encoding="utf-8")
    rows = manifests.read_manifest(spark, str(one)).collect()
    assert sorted(r.record.get("png") or r.record.get("image") for r in rows if r.record) == ["a.png", "b.png"]
    assert [r.error for r in rows if r.error] != []
    wrapped = tmp_path / "m.json"
    wrapped.write_text(json.dumps({"records": [{"path": "c.png"}, {"path": "d.png"}]}, indent=1), encoding="utf-8")
    got = manifests.read_manifest(spark, str(wrapped)).collect()
    assert sorted(r.record["path"] for r in got) == ["c.png", "d.png"] and not any(r.error for r in got)


def test_results_round_trip_is_deterministic(spark, tmp_path):
    rows = [("b", "s2", "ok", "confirmed", 0.5, "x"), ("a", "s1", "ok", "rejected", 0.0, None)]
    outputs = []
    for i, order in enumerate((rows, rows[::-1])):
        df = spark.createDataFrame(order, manifests.RESULT)
        path = str(tmp_path / f"r{i}")
        sinks.write_results(df.coalesce(1), path)
        outputs.append([r.value for r in spark.read.text(path).collect()])
        back = manifests.load_results(spark, path)
        assert sorted(map(tuple, back.collect()), key=str) == sorted(rows, key=str)
    assert sorted(outputs[0]) == sorted(outputs[1])


def test_recognizer_errors_are_data_and_fallback_runs_last(spark):
    def primary(payload, variant):
        if payload == b"bad":
            raise ValueError("no")
        return [{"text": payload.decode(), "confidence": 0.9 if payload == b"STOP" else 0.5}]

    def fallback(payload, variant):
        return [{"text": payload.decode(), "confidence": 0.5}]

    assets = spark.createDataFrame([("1", bytearray(b"STOP")), ("2", bytearray(b"BEER")), ("3", bytearray(b"bad"))], "asset_id string, payload binary")
    got = {r.asset_id: r for r in recognizer.scan_assets(assets, ("one", primary), ("two", fallback), ["v0", "v1"]).collect()}
    assert (got["1"].tier, got["1"].variant_calls) == ("confirmed", 1)
    # two primary calls, then the fallback's first reading agrees
    assert (got["2"].tier, got["2"].variant_calls) == ("confirmed", 3)
    assert got["3"].status == "error" and got["3"].error.startswith("one/v0")


def test_catalog_write(spark, tmp_path):
    refs = spark.createDataFrame(
        [("t1", "map", "woods"), ("t1", "map", "shore"), ("t2", "item", "food"), ("t3", "unknown", None)],
        "asset_id string, asset_type string, group string",
    )
    rows = selection.catalog_destinations(refs)
    sinks.write_catalog(rows, str(tmp_path / "c"))
    got = {(r.asset_id, r.root, r.folder) for r in spark.read.parquet(str(tmp_path / "c")).collect()}
    assert got == {("t1", "maps", "_shared"), ("t2", "items", "food"), ("t3", "unknown", "_unassigned")}
