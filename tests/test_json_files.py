"""Numbered lines and JSON entries of files cut into small byte ranges."""

import json
import random

import pytest

from assetspark.sources import json_files, manifests


@pytest.fixture()
def small_ranges(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    spark.conf.unset("spark.sql.files.openCostInBytes")


WILD = ["plain", 'quo"te', "back\\slash", 'both\\"', "com,ma", "br{ac]e", "[{,}]", "é\n\t", "", '\\\\",', "x" * 90]


def value(rng, depth=0):
    kind = rng.randrange(7 if depth < 3 else 4)
    if kind < 2:
        return rng.choice(WILD)
    if kind == 2:
        return rng.choice([1, -2.5, True, None])
    if kind == 3:
        return {}
    if kind == 4:
        return [value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice(WILD) + str(i): value(rng, depth + 1) for i in range(rng.randrange(4))}


def test_lines_are_numbered_over_ranges(spark, small_ranges, tmp_path):
    rng = random.Random(1)
    for name in ("a", "b"):
        (tmp_path / name).write_text("".join(f"{i}:{'y' * rng.randrange(40)}\n" if rng.random() < 0.8 else "\n" for i in range(1, 90)), encoding="utf-8")
    rows = json_files.numbered_lines(spark, str(tmp_path)).collect()
    got = {(r.path.rsplit("/", 1)[1], r.line): r.value for r in rows}
    want = {(p.name, i): line for p in tmp_path.iterdir() for i, line in enumerate(p.read_text().split("\n")[:-1], 1)}
    assert got == want and len(rows) == len(want)


@pytest.mark.parametrize("indent", [None, 1])
def test_entries_of_wild_files(spark, small_ranges, tmp_path, indent):
    rng = random.Random(2)
    listed = [value(rng) for _ in range(40)]
    named = {f"k{i}" + rng.choice(WILD): value(rng) for i in range(40)}
    nested = {"schema": 3, "first": [value(rng) for _ in range(15)], "flat": {"a": 1}, "none": [], "text": 'a,"]}', "last": [value(rng) for _ in range(15)]}
    for name, content in (("list", listed), ("named", named), ("nested", nested)):
        (tmp_path / name).write_text(json.dumps(content, indent=indent), encoding="utf-8")

    def read(name, depth):
        return json_files.json_entries(spark, str(tmp_path / name), depth).orderBy("number").collect()

    rows = read("list", 2)
    assert [json.loads(r.value) for r in rows] == listed
    assert {(r.name, r.container, r.damaged) for r in rows} == {(None, "list", False)}
    rows = read("named", 1)
    assert {json.loads(f'"{r.name}"'): json.loads(r.value) for r in rows} == named and len(rows) == len(named)
    rows = read("nested", 2)
    for key in ("first", "last"):
        assert [json.loads(r.value) for r in rows if r.name == key and r.container == "list"] == nested[key]
    members = {r.name: json.loads(r.value) for r in rows if r.container == "member"}
    assert members == {"schema": 3, "text": 'a,"]}'}
    assert not [r for r in rows if r.name == "none"]
    (tmp_path / "cut").write_text(json.dumps(nested)[:-40], encoding="utf-8")
    assert all(r.damaged for r in read("cut", 2))
    (tmp_path / "scalar").write_text("12", encoding="utf-8")
    assert read("scalar", 2) == []


def test_manifest_files(spark, small_ranges, tmp_path):
    lines = tmp_path / "m.jsonl"
    lines.write_text('{"image": "a"}\n\n[1]\n{"image": "b"\n{"image": "c"}\n', encoding="utf-8")
    got = sorted((r.line, r.record and r.record["image"], r.error) for r in manifests.read_manifest(spark, str(lines)).collect())
    assert got == [(1, "a", None), (3, None, "unsupported_manifest"), (4, None, "unsupported_manifest"), (5, "c", None)]

    def read(content):
        path = tmp_path / f"m{random.random()}.json"
        path.write_text(content if isinstance(content, str) else json.dumps(content), encoding="utf-8")
        return sorted(((r.record or {}).get("image", ""), r.error) for r in manifests.read_manifest(spark, str(path)).collect())

    images = [{"image": f"i{i:03}", "note": "a, [b]"} for i in range(60)]
    want = [(i["image"], None) for i in images]
    assert read(images) == want and read({"x": 1, "records": images}) == want
    assert read({"records": [{"image": "no"}], "assets": images}) == want  # assets come before records
    assert read({"assets": {"image": "no"}, "entries": images}) == want
    assert read([]) == [] and read({"entries": []}) == []
    assert read([{"image": "a"}, 5]) == [("", "not_an_object"), ("a", None)]
    for wrong in ({"other": images}, "12", json.dumps(images)[:-9]):
        assert read(wrong) == [("", "unsupported_manifest")]


def test_catalog_and_inventory_files(spark, small_ranges, tmp_path):
    catalog = {f"bundle/{i}": {"Crc": i, "Dependencies": [f"bundle/{j}" for j in range(i % 4)]} for i in range(50)}
    (tmp_path / "c.json").write_text(json.dumps(catalog, indent=2), encoding="utf-8")
    got = {(r.bundle_key, r.depends_on) for r in manifests.read_catalog(spark, str(tmp_path / "c.json")).collect()}
    assert got == {(k, d) for k, v in catalog.items() for d in v["Dependencies"]}
    inventory = {"schema_version": 2, "records": [{"id": str(i)} for i in range(30)], "renderers": [{"id": "r"}], "other": [1]}
    (tmp_path / "i.json").write_text(json.dumps(inventory), encoding="utf-8")
    rows = manifests.read_inventory(spark, str(tmp_path / "i.json")).collect()
    assert sorted((r.section, r.record["id"]) for r in rows) == sorted([("records", str(i)) for i in range(30)] + [("renderers", "r")])
    assert {(r.schema_version, r.error) for r in rows} == {(2, None)}
    (tmp_path / "j.json").write_text(json.dumps(inventory | {"schema_version": 7}), encoding="utf-8")
    assert [(r.schema_version, r.error) for r in manifests.read_inventory(spark, str(tmp_path / "j.json")).collect()] == [(7, "unsupported_schema")]
    (tmp_path / "k.json").write_text(json.dumps(inventory)[:-3], encoding="utf-8")
    assert [r.error for r in manifests.read_inventory(spark, str(tmp_path / "k.json")).collect()] == ["damaged_json"]
