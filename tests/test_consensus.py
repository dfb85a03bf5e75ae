import random
import unicodedata

import pytest

from assetspark.functions.boxes import SIDES
from assetspark.operators import consensus

READING = "image_id long, seq long, text string, script string, confidence double, engine string, model_signature string, rotation_deg int, x0 long, y0 long, x1 long, y1 long"


def reading(seq, word, conf, box, engine="a", rotation=0, image=1, script="latin"):
    return (image, seq, word, script, conf, engine, f"{engine}-m", rotation, *box)


def random_readings(n, images, seed=3):
    rng = random.Random(seed)
    out = []
    for seq in range(n):
        x, y = rng.randrange(120), rng.randrange(120)
        box = (x, y, x + rng.choice([20, 30, 60]), y + rng.choice([15, 20, 40]))
        if rng.random() < 0.3 and out:
            box = rng.choice(out)[8:12]
        out.append(reading(seq, rng.choice(["Facts", "Nutrition Facts", "Beer", ""]), rng.choice([0.5, 0.8, 0.9, 0.95]), box, rng.choice("abc"), 0, seq % images))
    return out


def clusters(df):
    return {(r.image_id, r.seq): r.cluster_id for r in consensus.greedy_clusters(df).collect()}


def python_clusters(rows):
    def area(b):
        return (b[2] - b[0]) * (b[3] - b[1])

    def same(p, q):
        a, b = p[8:12], q[8:12]
        inter = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
        if inter / max(1, area(a) + area(b) - inter) >= 0.55:
            return True
        s, t = (x[2].replace(" ", "").lower() for x in (p, q))
        return bool(s and t) and (s in t or t in s) and inter / max(1, min(area(a), area(b))) >= 0.85

    out = {}
    for image in {r[0] for r in rows}:
        groups = []
        for r in sorted((r for r in rows if r[0] == image), key=lambda r: -r[4]):
            home = next((g for g in groups if any(same(m, r) for m in g)), None)
            if home is None:
                groups.append([r])
            else:
                home.append(r)
        out.update({(image, m[1]): g[0][1] for g in groups for m in g})
    return out


def dense_readings(n, seed):
    """One crowded spot: many equal and nearly equal boxes."""
    rng = random.Random(seed)
    return [
        reading(i, rng.choice(["Facts", "Nutrition Facts", "Nut", ""]), rng.choice([0.5, 0.7, 0.9]), (rng.randrange(4), rng.randrange(4), 40 + rng.randrange(6), 30 + rng.randrange(6)), rng.choice("ab"))
        for i in range(n)
    ]


def chain_readings(n, seed):
    """Boxes that overlap their neighbours only, in a row across the whole picture, in any order of confidence."""
    rng = random.Random(seed)
    out = [reading(i, "Beer", round(rng.random(), 4), (i * 5, 10, i * 5 + 20, 30)) for i in range(n)]
    return out + [reading(n, "Flat", 0.9, (50, 10, 50, 30)), reading(n + 1, "Flat", 0.8, (50, 10, 50, 30))]


DRAWN = [random_readings(160, 3), dense_readings(150, 1), chain_readings(200, 2), [], [reading(1, None, 0.5, (0, 0, 9, 9))]]


@pytest.mark.parametrize("rows", DRAWN[:4])
def test_clusters_follow_the_greedy_rule(spark, rows):
    assert clusters(spark.createDataFrame(rows, READING)) == python_clusters(rows)


def test_components_part_only_what_never_overlaps(spark):
    rows = random_readings(300, 4, seed=8) + chain_readings(60, 3)
    rows = [(*r[:1], i, *r[2:]) for i, r in enumerate(rows)]
    got = {r.seq: (r.image_id, r._c0, r._c1, r._c2) for r in consensus.overlap_components(spark.createDataFrame(rows, READING)).collect()}
    assert len(got) == len(rows)
    for p in rows:
        for q in rows:
            a, b = p[8:12], q[8:12]
            if p[0] == q[0] and min(a[2], b[2]) > max(a[0], b[0]) and min(a[3], b[3]) > max(a[1], b[1]):
                assert got[p[1]] == got[q[1]]
    apart = [reading(1, "a", 0.5, (0, 0, 5, 5)), reading(2, "a", 0.5, (5, 0, 9, 5)), reading(3, "a", 0.5, (0, 6, 9, 9)), reading(4, "a", 0.5, (0, 5, 9, 6))]
    assert len({tuple(r) for r in consensus.overlap_components(spark.createDataFrame(apart, READING)).select("_c0", "_c1", "_c2").collect()}) == 4


def python_suppression(rows, candidate, order, covers):
    """The greedy rule on every image: equal boxes (and texts, where they count) by their best reading."""
    kept = set()
    for image in {r[0] for r in rows}:
        done = []
        for r in sorted((r for r in rows if r[0] == image and candidate(r)), key=order):
            if not any(covers(k, r) for k in done):
                done.append(r)
        kept |= {(image, r[1]) for r in done}
    return kept


def smaller(p, q):
    a, b = p[8:12], q[8:12]
    inter = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
    return inter / max(1, min((s[2] - s[0]) * (s[3] - s[1]) for s in (a, b)))


def box_area(r):
    return (r[10] - r[8]) * (r[11] - r[9])


@pytest.mark.parametrize("rows", DRAWN[:4])
def test_suppression_follows_the_greedy_rule(spark, rows):
    df = spark.createDataFrame(rows, READING)
    wide = lambda r: r[10] - r[8] >= 4 and r[11] - r[9] >= 4 and r[4] >= 0.45
    got = {(r.image_id, r.seq) for r in consensus.visual_regions(df).collect()}
    assert got == python_suppression(rows, wide, lambda r: (-box_area(r), -r[4], r[1]), lambda k, r: smaller(k, r) >= 0.78 and k[4] >= r[4] * 0.7)
    sure = lambda r: r[4] >= 0.75 and bool(r[2].strip())
    got = {(r.image_id, r.seq) for r in consensus.reference_regions(df, "latin").collect()}
    assert got == python_suppression(rows, sure, lambda r: (-box_area(r), -len(r[2]), -r[4], r[1]), lambda k, r: smaller(k, r) >= 0.8 and r[2] in k[2])


def test_one_path_without_jobs_while_planning(spark):
    df = spark.createDataFrame(DRAWN[0], READING)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("planning", "no job may run")
    try:
        consensus.greedy_clusters(df), consensus.visual_regions(df), consensus.reference_regions(df)
        assert not tracker.getJobIdsForGroup("planning")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert clusters(spark.createDataFrame(DRAWN[4], READING)) == {(1, 1): 1}


def chosen(spark, rows):
    clustered = consensus.cluster_readings(spark.createDataFrame(rows, READING))
    best = consensus.consensus(clustered)
    states = consensus.review_states(best, consensus.alternatives(clustered))
    return best.collect(), states.collect()


def test_weak_noise_is_no_conflict(spark):
    box = (10, 10, 60, 30)
    _, states = chosen(spark, [reading(1, "PPG", 0.95, box), reading(2, "9", 0.2, box, "b")])
    assert [s.conflicting_readings for s in states] == [False]


def test_rotation_vote_prefers_more_models(spark):
    box = (10, 10, 60, 30)
    rows = [reading(1, "ICEGREEN", 0.9999, box, "a", 270), reading(2, "ICEGREEN", 0.9, box, "a", 0), reading(3, "ICEGREEN", 0.9, box, "b", 0)]
    best, _ = chosen(spark, rows)
    assert [b.rotation_deg for b in best] == [0]


def test_contained_word_joins_the_full_line(spark):
    rows = [
        reading(1, "Nutrition Facts", 0.95, (10, 10, 110, 30)), reading(2, "Facts", 0.999, (60, 11, 109, 29)),
        reading(3, "Nutrition Facts", 0.9, (10, 10, 110, 30), "b"),
    ]
    best, _ = chosen(spark, rows)
    assert [b.text for b in best] == ["Nutrition Facts"]


def python_order(tokens):
    lines = []
    for t in sorted(tokens, key=lambda t: (t[4], t[3], t[1])):
        home = next((ln for ln in lines if abs(t[4] - ln["c"]) <= max(t[5], ln["h"]) * 0.6), None)
        if home is None:
            home = {"c": t[4], "h": t[5], "v": []}
            lines.append(home)
        home["v"].append(t)
        n = len(home["v"])
        home["c"] = (home["c"] * (n - 1) + t[4]) / n
        home["h"] = max(home["h"], t[5])
    lines.sort(key=lambda ln: ln["c"])
    out, place = {}, 0
    for i, ln in enumerate(lines):
        for t in sorted(ln["v"], key=lambda t: t[3]):
            out[(t[0], t[1])] = (i, place)
            place += 1
    return out


def test_reading_order_equals_brute_force(spark):
    rng = random.Random(11)
    tokens = [
        (call, call * 100 + i, "w", float(rng.randrange(300)), float(rng.randrange(90)), float(rng.randrange(6, 22)))
        for call in range(40) for i in range(rng.randrange(1, 25))
    ]
    df = spark.createDataFrame(tokens, "call_id long, seq long, text string, cx double, cy double, height double")
    got = {(r.call_id, r.seq): (r.line, r.ordinal) for r in consensus.reading_order(df).collect()}
    want = {}
    for call in range(40):
        want.update(python_order([t for t in tokens if t[0] == call]))
    assert got == want


def test_span_keeps_newlines_between_lines(spark):
    tokens = spark.createDataFrame(
        [(1, 1, 0, 0, "열량", 0.91), (1, 1, 1, 0, "80", 0.98), (1, 1, 2, 1, "kcal", 0.9)],
        "call_id long, region_id long, ordinal long, line long, text string, confidence double",
    )
    expected = spark.createDataFrame([(1, "열량 80\nkcal"), (1, "열량 80 kcal"), (1, "80")], "region_id long, expected_text string")
    got = {(r.expected_text, r["first"], r["last"], r.confidence) for r in consensus.spans_equal_to(tokens, expected).collect()}
    assert got == {("열량 80\nkcal", 0, 2, 0.9), ("80", 1, 1, 0.98)}


def test_composite(spark):
    df = spark.createDataFrame([(1, 1, " 열량", 0.91), (1, 2, "80kcal", 0.98), (2, 3, "x", 0.5)], "call_id long, seq long, text string, confidence double")
    assert [(r.text, r.confidence) for r in consensus.call_composites(df).collect()] == [("열량 80kcal", 0.91)]


def test_boxes_are_named():
    assert SIDES == ["x0", "y0", "x1", "y1"]


def test_all_spans_equal_plain_enumeration(spark):
    rng = random.Random(12)
    rows = []
    for call in range(30):
        line = 0
        for i in range(rng.randrange(0, 9)):
            line += rng.random() < 0.3
            rows.append((call, call % 4, i, line, rng.choice([" ab", "c", "", "  ", "é", "ab"]), rng.choice([0.5, 0.7, 0.1234567]), "one", f"m{call % 2}", "v"))
    schema = "call_id long, region_id long, ordinal long, line long, text string, confidence double, engine string, model_signature string, variant string"
    df = spark.createDataFrame(rows, schema)
    want, candidates = {}, []
    for call in range(30):
        tokens = [r for r in rows if r[0] == call and r[4].strip()]
        candidates += [(-t[5], call, False, t[2], t[2], t, unicodedata.normalize("NFC", t[4])) for t in tokens]
        for a in range(len(tokens)):
            for b in range(a + 2, len(tokens) + 1):
                span = tokens[a:b]
                text = "".join(("" if i == 0 else " " if t[3] == span[i - 1][3] else "\n") + unicodedata.normalize("NFC", t[4]).strip() for i, t in enumerate(span))
                low = round(min(t[5] for t in span), 6)
                want[(call, span[0][2], span[-1][2])] = (text, low, [t[4] for t in span])
                candidates.append((-low, call, True, span[0][2], span[-1][2], span[0], text))
    got = consensus.composite_spans(df).collect()
    assert len(got) == len(want) and {(r.call_id, r["first"], r["last"]): (r.text, r.confidence, r.components) for r in got} == want
    best = {}
    for c in sorted(candidates, key=lambda c: c[:5]):
        best.setdefault((c[5][1], c[5][7], c[6]), c)
    found = {(r.region_id, r.model_signature, r.text): (-r.confidence, r.call_id, r.components is not None, r["first"], r["last"]) for r in consensus.region_readings(df).collect()}
    assert found == {k: c[:5] for k, c in best.items()}
    assert consensus.composite_spans(df.limit(0)).count() == 0


def test_small_pictures_are_walked_whole_and_large_ones_cut(spark, monkeypatch):
    rng = random.Random(3)
    corners = [(rng.randrange(900), rng.randrange(900)) for _ in range(240)]
    rows = [reading(i, rng.choice("abc"), rng.random(), (x, y, x + 40, y + 30), image=i % 3) for i, (x, y) in enumerate(corners)]
    df = spark.createDataFrame(rows, READING)

    def walked(limit):
        monkeypatch.setattr(consensus, "WHOLE", limit)
        parts = consensus._walked_apart(df).select("image_id", *consensus.COMPONENT).distinct().count()
        return parts, sorted(map(tuple, consensus.cluster_readings(df).collect()))

    (whole, same), (cut, other) = walked(80), walked(79)
    assert whole == 3 and cut > 3 and same == other
    assert consensus.cluster_readings(df).columns == [*df.columns, "key", "cluster_id"]


def test_one_shuffle_per_vote_level(spark):
    clustered = spark.createDataFrame([(*reading(0, "a", 0.5, (0, 0, 9, 9)), "a", 0)], READING + ", key string, cluster_id long")
    plan = consensus.consensus(clustered)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2
    assert "Join" not in plan


def test_spans_are_sent_before_they_are_sorted(spark):
    schema = "call_id long, region_id long, engine string, model_signature string, variant string, ordinal long, line long, text string, confidence double"
    rows = [(call, 1, "e", "m", "v", i, 0, word, 0.5 + call / 10) for call in range(2) for i, word in enumerate(["a", "b", "a"])]
    out = consensus.region_readings(spark.createDataFrame(rows, schema))
    got = {r.text: (r.call_id, r.first, r.last, r.components) for r in out.collect()}
    assert got == {"a": (1, 0, 0, None), "b": (1, 1, 1, None), "a b": (1, 0, 1, ["a", "b"]), "b a": (1, 1, 2, ["b", "a"]), "a b a": (1, 0, 2, ["a", "b", "a"])}
    plan = consensus.region_readings(spark.createDataFrame(rows, schema))._jdf.queryExecution().executedPlan().toString()
    assert plan.index("SortAggregate") < plan.index("Exchange hashpartitioning(region_id")
    assert "SortAggregate" not in plan[plan.index("Exchange hashpartitioning(region_id") :]
