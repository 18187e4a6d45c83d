from twinscope import streaming


def test_set_once(spark, tmp_path):
    schema = "orig_addr long, recomp_addr long"
    for i, rows in enumerate(([(1, 8), (1, 5), (2, 6), (1, 7)], [(1, 2), (3, 7)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = streaming.set_once(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == [(1, 5), (2, 6), (3, 7)]


def test_best_of(spark, tmp_path):
    schema = "sample_id int, filename string, orig_addr string, recomp_addr string, name string, type int, accuracy double, is_effective_match boolean, is_stub boolean"
    kept = {}
    load = lambda: kept.get("t")
    save = lambda df: kept.update(t=spark.createDataFrame(df.collect(), df.schema))
    for k, acc in enumerate((0.5, 0.9, 0.7)):
        spark.createDataFrame([(k, "a", "0x1", "0x2", "f", 1, acc, False, False)], schema).write.mode("append").parquet(str(tmp_path / "in"))
        streaming.best_of(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), load, save).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(120)
    assert [r.accuracy for r in kept["t"].collect()] == [0.9]
