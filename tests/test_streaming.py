"""A catalog fed by a stream holds each key once, over restarts."""

from terraloom.streaming.ingest import ingest


def test_ingest_resumes_and_adds_each_key_once(spark, tmp_path):
    schema, source, catalog = "prefix string, level int", f"{tmp_path}/in", f"{tmp_path}/catalog"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    run = lambda: ingest(spark, source, schema, catalog, f"{tmp_path}/checkpoint", ["prefix"], "level", files_per_trigger=1).awaitTermination(60)
    put([("a", 2), ("a", 1), ("b", 1)])
    assert run()
    put([("b", 9), ("c", 3)])
    assert run() and run()
    assert sorted((r.prefix, r.level) for r in spark.read.parquet(catalog).collect()) == [("a", 1), ("b", 1), ("c", 3)]
