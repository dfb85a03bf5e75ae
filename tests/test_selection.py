import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from assetspark.functions import ids, text
from assetspark.operators import selection

DETECTION = "asset_id string, seq long, text string, confidence double, engine string, variant string"


def tiers(spark, rows):
    out = selection.classify(spark.createDataFrame(rows, DETECTION)).collect()
    return {r.asset_id: r for r in out}


def det(asset, seq, word, conf, engine="one"):
    return (asset, seq, word, conf, engine, "v")


def test_script_letters(spark):
    cases = {
        "WARNING": (7, 0), "АВС": (0, 3), "PАY": (2, 1), "한국어 123 !? ́": (0, 0), "Café Ёж": (4, 2), "Straße": (6, 0),
    }
    df = spark.createDataFrame([(k,) for k in cases], "text string")
    rows = selection.with_letters(df).collect()
    assert {r.text: (r.latin, r.cyrillic) for r in rows} == cases


def test_confidence(spark):
    raw = [None, "bad", "-0.5", "1.5", "0.75", "NaN", "Infinity"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(raw)], "i int, v string")
    got = [r.c for r in df.select("i", text.clamp_confidence(F.col("v")).alias("c")).orderBy("i").collect()]
    assert got == [0, 0, 0, 1, 0.75, 0, 0]


def test_text_identity(spark):
    df = spark.createDataFrame([("Café-12 ß!",), ("a\r\nb\rc",), ("Ж Ы²",)], "t string")
    rows = df.select(
        text.agreement_text(F.col("t")).alias("a"), text.literal_text(F.col("t")).alias("l"), text.script_label(F.col("t")).alias("s")
    ).collect()
    assert [r.a for r in rows] == ["café12ss", "abc", "жы²"]
    assert rows[1].l == "a\nb\nc"
    assert [r.s for r in rows] == ["latin", "latin", "cyrillic"]


def test_tiers(spark):
    rows = [
        det("a", 1, "STOP", 0.80), det("b", 1, "СТ", 0.45), det("c", 1, "AB", 0.4499), det("d", 1, "A", 0.99),
        det("e", 1, "СТОП", 0.45), det("e", 2, "СТОП", 0.45, "two"),
        det("f", 1, "AB", 0.45), det("f", 2, "АБ", 0.45, "two"),
        det("g", 1, "12345", 0.99), det("g", 2, "СТОП", 0.50),
        det("h", 1, "한국어 123", 0.99), det("i", 1, " ", 0.35),
    ]
    got = tiers(spark, rows)
    assert {k: v.tier for k, v in got.items()} == {
        "a": "confirmed", "b": "probable", "c": "needs_review", "d": "needs_review", "e": "confirmed", "f": "probable",
        "g": "probable", "h": "rejected", "i": "needs_review",
    }
    assert got["e"].reason_codes.endswith("engine_agreement") and got["e"].engine_count == 2 and got["e"].scripts == "cyrillic"
    assert got["g"].score == 0.50 and got["i"].reason_codes == "detector_only"


def test_agreement_equals_brute_force(spark):
    rng = random.Random(7)
    words = ["WARNING", "WARNINGS", "WARMING", "STOPSIGN", "STOP SIGN", "BEER", "BEERS", "DEER", "Nutrition facts", "Nutrtion fact", "xx"]
    rows = []
    for seq in range(600):
        word = list(rng.choice(words))
        if rng.random() < 0.4:
            word[rng.randrange(len(word))] = rng.choice("abcdeXYZ")
        rows.append((str(rng.randrange(90)), seq, "".join(word), rng.choice([0.3, 0.5, 0.9]), rng.choice(["p", "q", "r"]), "v"))
    want = set()
    for asset in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == asset and r[3] >= 0.45]
        for i, a in enumerate(mine):
            for b in mine[i + 1 :]:
                left, right = ("".join(c for c in s[2].lower() if c.isalnum()) for s in (a, b))
                if a[4] != b[4] and SequenceMatcher(None, left, right).ratio() >= 0.8:
                    want.add(asset)
    df = spark.createDataFrame(rows, DETECTION)
    got = {r.asset_id for r in selection.agreeing_assets(selection.with_letters(df)).collect()}
    assert got == want


@pytest.mark.parametrize("least", [0.55, 1.0])
def test_agreement_at_other_similarities(spark, least):
    rng = random.Random(8)
    rows = [
        (str(rng.randrange(60)), i, "".join(rng.choice("abz") for _ in range(rng.randrange(1, 14))), 0.9, rng.choice("pq"), "v") for i in range(240)
    ]
    want = set()
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            if a[0] == b[0] and a[4] != b[4] and SequenceMatcher(None, a[2], b[2]).ratio() >= least:
                want.add(a[0])
    found = selection.agreeing_assets(selection.with_letters(spark.createDataFrame(rows, DETECTION)), selection.Thresholds(agreement_similarity=least))
    assert {r.asset_id for r in found.collect()} == want


def test_color_filter(spark):
    names = {"poster_D": None, "poster_normal": "non_color_suffix:normal", "poster_n_LOD0": "non_color_token", "original_sign": None, "---": None}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = {r.n: r.k for r in df.select("n", selection.color_skip_reason(F.col("n")).alias("k")).collect()}
    assert got == names


def test_cached_result_states(spark):
    work = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "cache_key string")
    cache = spark.createDataFrame([("a", '{"n":1}'), ("b", "{bad"), ("c", "[1]")], "cache_key string, result_json string")
    got = {r.cache_key: r.state for r in selection.cache_state(work, cache).collect()}
    assert got == {"a": "hit", "b": "miss", "c": "miss", "d": "miss"}
    assert {r.state for r in selection.cache_state(work, cache, force=True).collect()} == {"miss"}


def test_limit_keeps_repeats_before_the_cut(spark):
    rows = [("a", "1", "P"), ("b", "2", "Q"), ("c", "3", "P"), ("d", "4", "R"), ("e", "5", "P")]
    df = spark.createDataFrame(rows, "path string, source_id string, pixel_sha256 string")
    assert sorted(r.path for r in selection.limit_groups(df, 2).collect()) == ["a", "b"]
    assert sorted(r.path for r in selection.limit_groups(df, 3).collect()) == ["a", "b", "c", "d"]
    assert selection.limit_groups(df, 9).count() == 5


@pytest.mark.parametrize(
    "name, start",
    [("CON", "_CON__"), ("a/b?.png", "a_b_"), ("", "asset__"), ("plain.png", "plain.png"), ("x" * 200 + ".png", "x" * 50)],
)
def test_safe_component(spark, name, start):
    df = spark.createDataFrame([(name,)], "n string")
    got = df.select(ids.sanitize_component(F.col("n"), F.lit("id"), 120).alias("c")).first().c
    assert got.startswith(start) and len(got) <= 120 and "/" not in got


def test_order_of_input_does_not_matter(spark):
    rows = [det(str(i % 5), i, w, 0.5) for i, w in enumerate(["STOP", "ab", "12", "Beer"] * 5)]
    one = sorted(map(str, selection.compact_detections(spark.createDataFrame(rows, DETECTION)).collect()))
    two = sorted(map(str, selection.compact_detections(spark.createDataFrame(rows[::-1], DETECTION)).collect()))
    assert one == two
