from datetime import datetime, timedelta

from assetspark.streaming import incremental

LOG = "asset_id long, decision string, reviewer string, reviewed_at timestamp"
T0 = datetime(2024, 1, 1)


def test_review_stream_keeps_the_latest_decision(spark, tmp_path):
    source = str(tmp_path / "in")
    batches = [
        [(1, "confirmed", "a", T0), (2, "rejected", "a", T0), (3, "bogus", "a", T0)],
        [(1, "clear", "b", T0 + timedelta(hours=1)), (2, "probable", "b", T0 - timedelta(hours=1))],
    ]
    table = incremental.review_table(spark, str(tmp_path / "out"))
    for rows in batches:
        spark.createDataFrame(rows, LOG).write.mode("append").parquet(source)
        stream = spark.readStream.schema(LOG).parquet(source)
        incremental.stream_into(incremental.allowed_reviews(stream), table, str(tmp_path / "cp")).awaitTermination()
    assert {(r.asset_id, r.decision) for r in incremental.visible_reviews(table).collect()} == {(2, "rejected")}
    table.upsert(spark.createDataFrame(batches[1][:1], LOG), 1)  # a repeated batch changes nothing
    assert {(r.asset_id, r.decision) for r in incremental.visible_reviews(table).collect()} == {(2, "rejected")}


def test_only_ok_results_are_stored(spark, tmp_path):
    rows = spark.createDataFrame(
        [("k", "{}", T0, "ok"), ("m", "{}", T0, "error")], "cache_key string, result_json string, created_at timestamp, status string"
    )
    table = incremental.result_table(spark, str(tmp_path / "cache"))
    table.upsert(incremental.storable_results(rows), 0)
    assert [r.cache_key for r in table.current().collect()] == ["k"]


def test_index_stream_replaces_rescanned_bundles(spark, tmp_path):
    source = str(tmp_path / "scan")
    schema = "name string, bundle_key string"
    index = incremental.BundleIndex(spark, str(tmp_path / "index"))
    assert index.current().count() == 0
    index.start(spark.createDataFrame([("old", "b0"), ("old", "b1"), ("x", "b3")], schema))

    def names():
        return {(r.name, r.bundle_key) for r in index.current().collect()}

    def run(rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        incremental.refresh_index_stream(stream, index, str(tmp_path / "cp")).awaitTermination()

    run([("a", "b1"), ("b", "b1"), ("a", "b1"), ("a", "b2")])
    assert names() == {("old", "b0"), ("x", "b3"), ("a", "b1"), ("b", "b1"), ("a", "b2")}  # batch 0 keeps the start
    last = [("c", "b1"), (None, "b3")]
    run(last)
    want = {("old", "b0"), ("c", "b1"), ("a", "b2")}
    assert names() == want  # b3 was scanned and has no names
    index.apply(spark.createDataFrame(last, schema), 1)
    assert names() == want
    written = {p.parent.name: p.stat().st_mtime_ns for p in (tmp_path / "index" / "delta").glob("version=0/_SUCCESS")}
    index.compact()
    assert names() == want
    index.apply(spark.createDataFrame([("late", "b1")], schema), 1)  # a replay of what the base holds
    assert names() == want
    run([("d", "b3"), (None, "b2")])
    assert names() == {("old", "b0"), ("c", "b1"), ("d", "b3")}
    assert written == {p.parent.name: p.stat().st_mtime_ns for p in (tmp_path / "index" / "delta").glob("version=0/_SUCCESS")}
