from conceptspark.operators import splits


def labels(spark):
    """1,250 ids in three cohorts, one of them with most of the rows."""
    rows = [("cohort", i, 0 if i < 1000 else 1 + i % 2) for i in range(1250)]
    return spark.createDataFrame(rows, "target string, transcript_id long, label int")


def test_sizes_and_strata(spark):
    out = splits.stratified_split(labels(spark), 42)
    sizes = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    assert sizes == {"train": 875, "val": 187, "test": 188}
    per_class = {(r["split"], r["label"]): r["n"] for r in splits.split_metadata(out).collect()}
    assert per_class[("train", 0)] == 700
    assert abs(per_class[("val", 1)] - 125 * 0.15) < 1


def test_no_leakage_and_reproducible(spark):
    table = labels(spark)
    out = splits.repeated_splits(table, [1, 2])
    for row in splits.split_leakage(out, table).collect():
        assert (row["n_leaked"], row["n_unplaced"]) == (0, 0)
    again = splits.repeated_splits(table.repartition(7), [2, 1])
    assert out.exceptAll(again).isEmpty() and again.exceptAll(out).isEmpty()
    one, two = out.where("seed = 1").drop("seed"), out.where("seed = 2").drop("seed")
    assert not one.exceptAll(two).isEmpty()


def test_leakage_is_found(spark):
    table = labels(spark)
    out = splits.stratified_split(table, 42).where("transcript_id <> 5")
    bad = out.unionByName(out.where("transcript_id = 7").withColumn("split", out["label"].cast("string")))
    row = splits.split_leakage(bad, table).first()
    assert (row["n_leaked"], row["n_unplaced"]) == (1, 1)


def test_holdout_share(spark):
    ids = spark.range(95).withColumnRenamed("id", "transcript_id")
    assert splits.holdout(ids, 0.1, 3).where("held_out").count() == 10
