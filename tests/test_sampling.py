from pyspark.sql import functions as F

from cardlake.operators import sampling


def labelled(spark, n=20_000):
    return spark.range(n).select("id", (F.col("id") % 20 == 0).cast("int").alias("fraud_label"))


def test_sample_keeps_all_frauds_and_a_tenth_of_the_rest(spark):
    df = labelled(spark)
    sample = sampling.balanced_sample(df)
    balance = {r["fraud_label"]: r["n_rows"] for r in sampling.class_balance(sample).collect()}
    assert balance[1] == 1000
    assert 1700 < balance[0] < 2100
    assert sample.exceptAll(sampling.balanced_sample(df.repartition(3))).isEmpty()
    assert not sample.exceptAll(sampling.balanced_sample(df, seed=7)).isEmpty()


def test_split_is_independent_of_the_sample(spark):
    sample = sampling.balanced_sample(labelled(spark))
    train, test = sampling.train_test_split(sample)
    assert train.count() + test.count() == sample.count()
    assert train.select("id").intersect(test.select("id")).isEmpty()
    for label in (0, 1):
        part, whole = train.where(F.col("fraud_label") == label).count(), sample.where(F.col("fraud_label") == label).count()
        assert 0.76 < part / whole < 0.84


def test_sampling_needs_no_shuffle(spark):
    frame = sampling.with_split(sampling.balanced_sample(labelled(spark)))
    assert "Exchange" not in frame._jdf.queryExecution().executedPlan().toString()
