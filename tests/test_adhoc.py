import pytest
from pyspark.errors import AnalysisException, ParseException

from cardlake.plans import adhoc


@pytest.fixture
def mart(spark):
    mart = spark.createDataFrame([("Visa", "Debit", 3), ("Amex", "Credit", 1)], "card_brand string, card_type string, nb_cartes bigint")
    adhoc.register_marts({"dm_cartes": mart})
    return mart


@pytest.mark.parametrize(
    "text",
    [
        "SELECT * FROM dm_cartes",
        "select * from dm_cartes ; ",
        "WITH c AS (SELECT * FROM dm_cartes) SELECT * FROM c",
        "SELECT * FROM dm_cartes -- all of it",
        "SELECT * FROM dm_cartes ORDER BY nb_cartes DESC",
    ],
)
def test_queries(spark, mart, text):
    assert sorted(adhoc.run_query(spark, text).collect()) == sorted(mart.collect())


def test_order_is_kept(spark, mart):
    result = adhoc.run_query(spark, "SELECT nb_cartes FROM dm_cartes ORDER BY nb_cartes")
    assert [r[0] for r in result.collect()] == [1, 3]


@pytest.mark.parametrize("text", ["", "  ;", None])
def test_empty_text(spark, text):
    with pytest.raises(ValueError, match="missing SQL query"):
        adhoc.run_query(spark, text)


@pytest.mark.parametrize(
    "text",
    [
        "DROP VIEW dm_cartes",
        "INSERT INTO dm_cartes VALUES ('x', 'y', 1)",
        "CREATE TABLE t AS SELECT 1",
        "SELECT 1; DROP VIEW dm_cartes",
        "SELECT * FROM dm_cartes) q; DROP VIEW dm_cartes --",
        "SELEC 1",
    ],
)
def test_only_queries_run(spark, mart, text):
    with pytest.raises(ParseException):
        adhoc.run_query(spark, text)
    assert spark.catalog.tableExists("dm_cartes")


def test_unknown_tables_and_repeated_columns(spark, mart):
    with pytest.raises(AnalysisException):
        adhoc.run_query(spark, "SELECT * FROM dm_nothing")
    with pytest.raises(ValueError, match="repeated result columns: card_brand"):
        adhoc.run_query(spark, "SELECT card_brand, 1 AS one, card_brand FROM dm_cartes")


def test_export(spark, mart, tmp_path):
    text = "SELECT card_brand, nb_cartes, concat(card_brand, ', \"x\"\n') AS odd FROM dm_cartes"
    result, path = adhoc.run_and_export(spark, text, str(tmp_path))
    assert result.dtypes == [("card_brand", "string"), ("nb_cartes", "bigint"), ("odd", "string")]
    expected = [("Amex", 1, 'Amex, "x"\n'), ("Visa", 3, 'Visa, "x"\n')]
    assert sorted(tuple(r) for r in result.collect()) == expected
    assert all(path in name for name in result.inputFiles())


@pytest.mark.parametrize(
    "text",
    [
        "SELECT java_method('java.lang.System', 'setProperty', 'cardlake.x', '1')",
        "SELECT reflect('java.lang.System', 'getProperty', 'user.home') AS p FROM dm_cartes",
        "SELECT card_brand FROM dm_cartes WHERE try_reflect('java.lang.System', 'getProperty', 'user.home') = 'x'",
        "SELECT (SELECT max(java_method('java.lang.System', 'setProperty', 'cardlake.x', '1')) FROM dm_cartes) AS p",
        "SELECT * FROM parquet.`{path}`",
        "SELECT * FROM csv.`{path}`",
        "SELECT * FROM private.secrets",
        "SELECT card_brand FROM dm_cartes WHERE nb_cartes IN (SELECT id FROM private.secrets)",
        "SELECT * FROM other_view",
        "SELECT * FROM range(5)",
    ],
)
def test_only_the_marts_can_be_read(spark, mart, tmp_path, text):
    path = f"{tmp_path}/p"
    spark.range(3).write.parquet(path)
    spark.range(2).createOrReplaceTempView("other_view")
    spark.sql("CREATE DATABASE IF NOT EXISTS private")
    spark.sql(f"CREATE TABLE IF NOT EXISTS private.secrets USING parquet LOCATION '{path}'")
    try:
        with pytest.raises((ValueError, AnalysisException)):
            adhoc.run_query(spark, text.format(path=path))
    finally:
        spark.sql("DROP DATABASE private CASCADE")
        spark.catalog.dropTempView("other_view")
    assert spark._jvm.java.lang.System.getProperty("cardlake.x") is None
    assert spark.conf.get("spark.sql.runSQLOnFiles") == "true"


@pytest.mark.parametrize(
    "text",
    [
        "SELECT 'View (`other_view`' AS a, 'Relation [x] parquet' AS b, nb_cartes FROM dm_cartes",
        "SELECT 'reflect(' AS `java_method(`, count(*) AS n FROM dm_cartes",
        "SELECT card_brand AS `Relation secrets`, rank() OVER (ORDER BY nb_cartes) AS r FROM dm_cartes",
        "SELECT max(nb_cartes) FILTER (WHERE card_type LIKE 'D%') AS m FROM dm_cartes GROUP BY GROUPING SETS ((card_brand), ())",
        "SELECT x, n FROM (SELECT explode(array(1, 2)) AS x, nb_cartes AS n FROM dm_cartes) WHERE n IN (SELECT max(nb_cartes) FROM dm_cartes)",
        "SELECT card_brand FROM dm_cartes UNION SELECT card_type FROM dm_cartes EXCEPT SELECT 'x'",
        "SELECT transform(array(nb_cartes), v -> v + 1) AS t, cast(nb_cartes AS string) AS s FROM dm_cartes ORDER BY s LIMIT 1",
        "SELECT * FROM (SELECT card_brand, card_type, nb_cartes FROM dm_cartes) PIVOT (sum(nb_cartes) FOR card_type IN ('Debit', 'Credit'))",
        "SELECT * FROM VALUES (1, 'a'), (2, 'b') AS t(n, c)",
        "WITH a AS (SELECT * FROM dm_cartes), b AS (SELECT * FROM a) SELECT a.card_brand FROM a JOIN b ON a.nb_cartes = b.nb_cartes",
        "SELECT card_brand, regexp_replace(card_type, 'i', 'o') AS o, date_format(current_date(), 'y') AS y FROM dm_cartes",
        "SELECT d.card_brand, l.n FROM dm_cartes d, LATERAL (SELECT d.nb_cartes + 1 AS n) l",
    ],
)
def test_names_and_texts_that_look_like_plans_are_harmless(spark, mart, text):
    adhoc.run_query(spark, text).collect()


@pytest.mark.parametrize(
    "text",
    [
        "WITH c AS (SELECT * FROM other_view) SELECT * FROM dm_cartes JOIN c ON true",
        "SELECT * FROM dm_cartes WHERE EXISTS (SELECT 1 FROM other_view WHERE id = nb_cartes)",
        "SELECT nb_cartes, (SELECT max(id) FROM other_view) AS m FROM dm_cartes",
        "SELECT transform(array(nb_cartes), v -> reflect('java.lang.System', 'lineSeparator')) AS t FROM dm_cartes",
        "SELECT shout(card_brand) AS s FROM dm_cartes",
        "SELECT nb_cartes FROM dm_cartes ORDER BY shout(card_brand)",
        "SELECT max(nb_cartes) AS m FROM dm_cartes GROUP BY reflect('java.lang.System', 'lineSeparator')",
        "SELECT input_file_name() AS f FROM dm_cartes",
        "SELECT d.card_brand, l.id FROM dm_cartes d, LATERAL (SELECT id FROM other_view WHERE id = d.nb_cartes) l",
        "SELECT card_brand FROM dm_cartes UNION ALL SELECT cast(id AS string) FROM other_view",
        "SELECT * FROM global_temp.dm_cartes",
    ],
)
def test_what_is_hidden_deep_in_a_query_is_refused(spark, mart, text):
    spark.range(4).createOrReplaceTempView("other_view")
    spark.range(4).createOrReplaceGlobalTempView("dm_cartes")
    spark.udf.register("shout", lambda text: text + "!")
    try:
        with pytest.raises(ValueError, match="mart|not allowed"):
            adhoc.run_query(spark, text)
    finally:
        spark.catalog.dropTempView("other_view")
        spark.catalog.dropGlobalTempView("dm_cartes")
        spark.sql("DROP TEMPORARY FUNCTION shout")


def test_marts_from_files_and_tables_can_be_joined(spark, tmp_path):
    spark.range(3).selectExpr("cast(id as string) AS card_brand", "id AS nb_cartes").write.parquet(f"{tmp_path}/m")
    adhoc.register_marts({"dm_cartes": spark.read.parquet(f"{tmp_path}/m"), "dm_clients": spark.range(2).selectExpr("id AS user_id")})
    text = "WITH c AS (SELECT * FROM dm_cartes) SELECT c.card_brand FROM c JOIN dm_clients ON nb_cartes = user_id"
    assert adhoc.run_query(spark, text).count() == 2
