"""The recognizer's stages against the plain rule over all readings so far."""

import random
from difflib import SequenceMatcher

from assetspark.operators import recognizer
from assetspark.operators.selection import Thresholds

WORDS = ["STOP", "STOPP", "STÖP", "стоп", "стол", "A", "AB", "12", "", " ", "한국어", "WARNING", "WARN1NG", "warning!", "WAREHOUSE"]
T = Thresholds()


def confirmed(readings):
    """The plain rule: best reading strong, or two engines with similar texts, every pair in order."""
    rows = [(e, t, c, recognizer.target_letters(t)) for e, t, c in readings]
    rows = [r for r in rows if r[3]]
    if not rows:
        return False
    best = max(rows, key=lambda r: (r[2], r[3], r[1]))
    if best[2] >= T.confirmed_score and best[3] >= T.confirmed_letters:
        return True
    keys = [(e, "".join(c.casefold() for c in t if c.isalnum())) for e, t, c, _ in rows if c >= T.agreement_score]
    return any(
        a != b and SequenceMatcher(None, left, right).ratio() >= T.agreement_similarity
        for i, (a, left) in enumerate(keys)
        for b, right in keys[i + 1 :]
    )


def drawn(rng):
    """Readings of each variant of one engine; None is a failure."""
    return [None if rng.random() < 0.08 else [(rng.choice(WORDS), rng.choice([0.1, 0.44, 0.45, 0.6, 0.79, 0.8, 0.95])) for _ in range(rng.randrange(4))] for _ in range(4)]


def plain_calls(one, two):
    readings, made = [], []
    for engine, plan in (("one", one), ("two", two)):
        if engine == "two" and confirmed(readings):
            break
        for k, found in enumerate(plan):
            made.append((engine, k, found is not None))
            if found is None:
                break
            readings += [(engine, t, c) for t, c in found]
            if confirmed(readings):
                break
    return made, confirmed(readings)


def test_state_follows_the_rule_after_every_reading():
    rng = random.Random(11)
    for _ in range(300):
        state, readings = recognizer.TierState(T), []
        for _ in range(8):
            readings.append((rng.choice(["one", "two", "three"]), rng.choice(WORDS), rng.choice([0.3, 0.45, 0.7, 0.8, 0.9])))
            state.add(*readings[-1])
            assert state.confirmed == confirmed(readings)


def test_calls_equal_the_plain_rule(spark):
    rng = random.Random(5)
    plans = {i: (drawn(rng), drawn(rng)) for i in range(150)}

    def engine(which):
        def recognize(payload, variant):
            found = plans[int(payload)][which][int(variant[1:])]
            if found is None:
                raise RuntimeError("no")
            return [{"text": t, "confidence": c} for t, c in found]

        return recognize

    assets = spark.createDataFrame([(i, bytearray(str(i).encode())) for i in plans], "asset_id long, payload binary")
    got = {r.asset_id: r for r in recognizer.scan_assets(assets, ("one", engine(0)), ("two", engine(1)), ["v0", "v1", "v2", "v3"]).collect()}
    for i, (one, two) in plans.items():
        made, sure = plain_calls(one, two)
        errors = " | ".join(f"{e}/v{k}: RuntimeError: no" for e, k, ok in made if not ok) or None
        calls = sum(ok for *_, ok in made)
        assert (got[i].variant_calls, got[i].error) == (calls, errors)
        assert (got[i].tier == "confirmed") == (sure and calls > 0)


def test_variants_that_fail_are_an_error_of_the_engine(spark):
    def capped(payload):
        yield "v0"
        raise OverflowError("too many variants")

    assets = spark.createDataFrame([("a", bytearray(b"x"))], "asset_id string, payload binary")
    read = ("one", lambda payload, variant: [{"text": "AB", "confidence": 0.5}])
    row = recognizer.scan_assets(assets, read, None, capped).first()
    assert (row.status, row.error, row.variant_calls, row.tier) == ("error", "one: OverflowError: too many variants", 1, "probable")
    both = recognizer.scan_assets(assets, read, ("two", lambda payload, variant: [{"confidence": "bad"}]), capped).first()
    assert both.error == "one: OverflowError: too many variants | two: OverflowError: too many variants"
    assert recognizer.scan_assets(assets.limit(0), read, read, ["v0"]).count() == 0


def test_calls_of_many_assets_share_a_batch():
    import pyarrow as pa

    walks = ([(asset, n, 0, "e", "v", None, None, True, None) for n in range(3)] for asset in range(5000))
    batches = list(recognizer._call_batches(walks, pa.int64()))
    assert len(batches) == 4 and sum(b.num_rows for b in batches) == 15000


def test_fallback_starts_from_the_readings_in_order(spark):
    assets = spark.createDataFrame([(1, b"a"), (2, b"b"), (3, b"c")], "asset_id long, payload binary")
    earlier = spark.createDataFrame(
        [(1, 1, "one", "Beer", 0.6), (1, 0, "one", "Stop", 0.6), (2, 0, "one", "Facts", 0.6)],
        "asset_id long, seq long, engine string, text string, confidence double",
    )
    out = recognizer.run_fallback(assets, earlier, "two", lambda payload, variant: [{"text": "Stop", "confidence": 0.6}], ["v0", "v1"])
    calls = [(r.asset_id, r.variant) for r in out.filter("ok is not null").collect()]
    assert sorted(calls) == [(1, "v0"), (2, "v0"), (2, "v1"), (3, "v0"), (3, "v1")]
    assert "FlatMapCoGroups" not in out._jdf.queryExecution().executedPlan().toString()
