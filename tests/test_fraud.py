import random

import pytest
from pyspark.sql import functions as F

from cardlake.operators import joins
from cardlake.operators.sampling import balanced_sample, train_test_split
from cardlake.plans import fraud
from cardlake.schemas import SCORING_INPUT


@pytest.fixture(scope="module")
def base(spark):
    """Frauds are large amounts in one state, with some noise."""
    dice = random.Random(1)
    rows = []
    for number in range(3000):
        is_fraud = number % 4 == 0
        amount = dice.uniform(600, 1000) if is_fraud else dice.uniform(0, 650)
        state = "CA" if is_fraud and dice.random() < 0.8 else dice.choice(["NY", "TX", None])
        rows.append(
            (
                number, int(is_fraud), amount, 5000.0, state, dice.choice(["VISA", "MASTERCARD"]), "DEBIT",
                dice.choice([0, 1]), dice.choice(["Restaurants", "Electronics"]),
            )
        )
    return spark.createDataFrame(
        rows,
        "id bigint, fraud_label int, amount_usd double, credit_limit_usd double, merchant_state string, "
        "card_brand string, card_type string, has_chip int, description string",
    ).cache()


@pytest.fixture(scope="module")
def model(base):
    return fraud.train(train_test_split(base)[0], max_iter=4)


def test_model_separates_and_survives_saving(spark, base, model, tmp_path):
    test = train_test_split(base)[1]
    scored = fraud.score(model, test)
    assert fraud.area_under_roc(scored) > 0.9
    path = str(tmp_path / "model")
    fraud.save(model, path)
    fraud.save(model, path)
    again = fraud.score(fraud.load(path), test)
    assert scored.select("id", "prediction", "fraud_probability").exceptAll(
        again.select("id", "prediction", "fraud_probability")
    ).isEmpty()


def test_scoring_rows_with_unseen_categories(spark, model):
    rows = spark.createDataFrame(
        [
            (31.0, 700.0, "ZZ", "NOBRAND", "PREPAID", "2", "Zeppelins"),
            (980.5, 700.0, "CA", "NOBRAND", "PREPAID", "1", "Zeppelins"),
            (44.0, 700.0, "TX", None, None, None, None),
        ],
        SCORING_INPUT,
    )
    scored = {r["merchant_state"]: r for r in fraud.score(model, rows).collect()}
    assert [scored[state]["prediction"] for state in ("ZZ", "CA", "TX")] == [0.0, 1.0, 0.0]
    assert scored["CA"]["fraud_probability"] == pytest.approx(scored["CA"]["probability"][1])
    with pytest.raises(ValueError, match="merchant_state"):
        fraud.check_inputs(rows.drop("merchant_state"))


def test_model_has_the_declared_shape(model):
    trees = model.stages[-1]
    assert trees.numFeatures == 7 and trees.getNumTrees == 4
    assert trees.getOrDefault("maxBins") == 200 and trees.getOrDefault("stepSize") == 0.1
    assert model.stages[1].getInputCols() == fraud.FEATURES


def test_index_order_and_missing_values(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("c",), (None,)], "s string")
    indexed = fraud.fit_indexers(df, ["s"]).transform(df)
    assert {r["s"]: r["s_idx"] for r in indexed.collect()} == {"c": 0.0, "a": 1.0, "b": 2.0, None: 3.0}


def test_missing_numbers_fail_or_are_left_out_and_counted(base):
    indexed = fraud.fit_indexers(base).transform(base)
    holes = indexed.withColumn("credit_limit_usd", F.when(F.col("id") % 100 > 0, F.col("credit_limit_usd")))
    with pytest.raises(Exception):
        fraud.assembler().transform(holes).collect()
    assert fraud.assembler("skip").transform(holes).count() == 2970
    assert tuple(fraud.missing_features(holes).first()) == (0, 30, 3000)


def test_more_categories_than_bins_fail_with_their_number(base):
    wide = base.where("id < 900").withColumn("description", (F.col("id") % 400).cast("string"))
    with pytest.raises(ValueError, match="description needs 401 bins, and max_bins is 200"):
        fraud.train(wide, max_iter=1)
    assert fraud.train(wide, max_iter=1, max_bins=401).stages[-1].getOrDefault("maxBins") == 401


def test_the_model_depends_on_the_rows_only(spark):
    """More rows than the trees look at for their bins, arriving in different parts and orders."""
    rows = spark.range(42_000).selectExpr(
        "id", "cast(pmod(xxhash64(id, 1), 100) < if(pmod(xxhash64(id, 2), 1000) > 700, 70, 10) as int) AS fraud_label",
        "pmod(xxhash64(id, 2), 1000) + pmod(xxhash64(id, 3), 97) / 97D AS amount_usd",
        "cast(pmod(xxhash64(id, 4), 9000) as double) AS credit_limit_usd", "concat('S', pmod(xxhash64(id, 5), 40)) AS merchant_state",
        "concat('B', pmod(xxhash64(id, 6), 3)) AS card_brand", "'DEBIT' AS card_type", "cast(id % 2 as int) AS has_chip",
        "concat('D', pmod(xxhash64(id, 7), 60)) AS description",
    )
    scored = []
    for parts in (2, 16):
        model = fraud.train(rows.repartition(parts, F.rand(parts)), max_iter=2)
        scored.append({r["id"]: (r["prediction"], r["fraud_probability"]) for r in fraud.score(model, rows).collect()})
    first, second = scored
    assert {i: p for i, (p, _) in first.items()} == {i: p for i, (p, _) in second.items()}
    assert all(abs(first[i][1] - second[i][1]) < 1e-9 for i in first)


def test_empty_training_set_is_refused(base):
    with pytest.raises(ValueError, match="training set is empty"):
        fraud.train(base.where("id < 0"))


def brute_auc(pairs):
    wins = sum(
        1.0 if p > n else 0.5 if p == n else 0.0 for p, is_p in pairs if is_p for n, is_n in pairs if not is_n
    )
    positives = sum(label for _, label in pairs)
    return wins / (positives * (len(pairs) - positives))


@pytest.mark.parametrize("levels", [3, 50, 10_000])
def test_auc_is_exact(spark, levels):
    dice = random.Random(levels)
    pairs = [(float(dice.randrange(levels)), int(dice.random() < 0.3)) for _ in range(1500)]
    df = spark.createDataFrame(pairs, "score double, fraud_label int")
    assert fraud.area_under_roc(df, "score") == pytest.approx(brute_auc(pairs), abs=1e-12)


def test_training_rows_are_the_sampled_base(spark):
    transactions = spark.range(5000).selectExpr(
        "id", "id % 9 AS card_id", "cast(id as double) AS amount_usd", "'NY' AS merchant_state", "cast(id % 3 as int) AS mcc"
    )
    labels = spark.range(6000).selectExpr("id", "if(id % 20 = 0, 'Yes', 'No') AS label")
    cards = spark.range(9).selectExpr(
        "id", "'Visa' AS card_brand", "'Debit' AS card_type", "true AS has_chip", "1.0D AS credit_limit_usd"
    )
    codes = spark.range(2).selectExpr("cast(id as int) AS mcc_code", "concat('c', id) AS description")
    rows = fraud.training_rows(transactions, labels, cards, codes)
    late = balanced_sample(joins.feature_base(transactions, joins.flag_labels(labels), cards, codes)).select(*rows.columns)
    assert rows.exceptAll(late).isEmpty() and late.exceptAll(rows).isEmpty()

    train, test = fraud.prepare_training(transactions, labels, cards, codes)
    assert train.unionByName(test).exceptAll(rows).isEmpty()
    assert train.count() + test.count() == rows.count()
    assert "Join" not in train._jdf.queryExecution().executedPlan().toString()
    assert fraud.arranged(train, 5).rdd.getNumPartitions() == 5
    more, _ = fraud.prepare_training(transactions, labels, cards, codes, keep_one_in=1, train_percent=100)
    assert more.count() == 5000
