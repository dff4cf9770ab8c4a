def test_entry_and_names(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_streaming_appends_once(spark, tmp_path):
    from tractspark.streaming import arrivals

    df = spark.range(10).selectExpr("id", "id % 2 as type")
    df.write.parquet(str(tmp_path / "in"))
    for want in (10, 10):
        arrivals.append_new(spark, str(tmp_path / "in"), df.schema, str(tmp_path / "out"), str(tmp_path / "log"))
        assert spark.read.parquet(str(tmp_path / "out")).count() == want


def test_prediction_csv(spark, tmp_path):
    from tractspark.sources import files

    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.csv").write_text("Fiber ID,First analog (µm),Second analog (µm),Ratio,Fiber type,Valid,Error probability,Image Name\n1,0.0,2.0,,double,true,0.1,c-1\n")
    row = files.read_predictions(spark, str(tmp_path)).first()
    assert (row.length_um, row.ratio, row.fiber_type) == (2.0, None, "two segments")
    assert files.list_files(spark, str(tmp_path), [".CSV"]).count() == 1


def test_running_summary_goes_on_after_a_stop(spark, tmp_path):
    import numpy as np

    from tractspark.streaming import arrivals

    rng = np.random.default_rng(0)
    rows = [("a" if k % 3 else "b", "AI" if k % 2 else None, float(v)) for k, v in enumerate(rng.lognormal(0, 1, 3000))] + [("c", "AI", None)]
    source, sink, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    schema = "type string, grader string, ratio double"
    for k in range(3):  # three arrivals, a stop after each
        spark.createDataFrame(rows[k * 1000 : (k + 1) * 1000 + (k == 2)], schema).repartition(2).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        arrivals.keep_summary(stream, ["type", "grader"], "ratio", sink, log)
    got = {(r.type, r.grader): r for r in arrivals.read_summary(spark, ["type", "grader"], sink).collect()}
    groups = {}
    for t, g, v in rows:
        groups.setdefault((t, g), []).append(v)
    assert set(got) == set(groups) and (got["c", "AI"].n, got["c", "AI"].quantiles) == (0, None)
    for key, values in groups.items():
        if key[0] != "c":
            r, values = got[key], np.sort(values)
            assert r.n == len(values) and abs(r["sum"] - values.sum()) < 1e-6 and abs(r["mean"] - values.mean()) < 1e-9
            for p, q in zip((0.25, 0.5, 0.75), r.quantiles):
                assert abs(np.searchsorted(values, q) - p * len(values)) <= 2 + len(values) / 1000


def test_labels_by_their_columns(spark, tmp_path):
    from tractspark.sources import files

    (tmp_path / "l.csv").write_text("name,is_error,length\na.png,1,2.5\n\"b, c.png\",0,\n")
    rows = files.read_labels(spark, str(tmp_path / "l.csv"), "name string, is_error int, length double").collect()
    assert [tuple(r) for r in rows] == [("a.png", 1, 2.5), ("b, c.png", 0, None)]
