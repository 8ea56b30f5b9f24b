"""CSV and JSON readers. Text that does not parse fails the job; it never becomes a null or a missing row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cardlake.schemas import LABEL_RECORDS


def read_csv(
    spark: SparkSession, path: str, schema: StructType | str | None = None, sep: str = ",", multiline: bool = False
) -> DataFrame:
    """CSV with a header line: text columns, or the declared types when a schema is given.

    A declared schema has to name the header's columns in their order, and every cell that is read has to fit its
    type. Quotes inside quoted cells are doubled. ``multiline`` reads line breaks inside cells; a file is then one task.
    """
    reader = spark.read.option("header", True).option("sep", sep).option("escape", '"').option("multiLine", multiline)
    if schema is not None:
        reader = reader.schema(schema).option("enforceSchema", False).option("mode", "FAILFAST")
    return reader.csv(path)


def explode_json_map(df: DataFrame, source: str, key: str, value: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per key of the JSON object in ``source``; of a repeated key the last value counts.

    Text that is no JSON object fails the job; a null has no rows.
    """
    parsed_map = F.from_json(F.col(source), "map<string,string>", {"mode": "FAILFAST"})
    parsed = df.select(*keep, F.map_entries(parsed_map).alias("_entries"))
    entries = F.col("_entries")

    def is_last(entry, position):
        later = F.slice(entries, position + 2, F.size(entries))
        return ~F.exists(later, lambda other: other["key"] == entry["key"])

    # Comparing every entry with all later ones is quadratic, so only objects with repeated keys pay for it.
    has_repeats = F.size(F.array_distinct(F.col("_entries.key"))) < F.size(entries)
    last = F.when(has_repeats, F.filter(entries, is_last)).otherwise(entries)
    rows = parsed.select(*keep, F.explode(last).alias("_entry"))
    return rows.select(*keep, F.col("_entry.key").alias(key), F.col("_entry.value").alias(value))


def read_code_map(spark: SparkSession, path: str, key: str = "mcc_code", value: str = "description") -> DataFrame:
    """Rows of a code list stored as one JSON object per file.

    Merchant category codes have four digits, so such a file stays below ten thousand entries.
    Use ``read_label_pairs`` for objects that grow with the data.
    """
    return explode_json_map(spark.read.text(path, wholetext=True), "value", key, value)


def _all_but(wrong: Column, what: str, text: Column) -> Column:
    """A filter that keeps every row, and fails at a wrong one."""
    message = F.concat(F.lit(f"not {what}: "), F.coalesce(text, F.lit("null")))
    return F.when(wrong, F.raise_error(message).cast("boolean")).otherwise(F.lit(True))


def read_label_records(spark: SparkSession, path: str) -> DataFrame:
    """Label file with one JSON record, or one array of records, per line.

    A record that does not parse, or has neither an id nor a label, fails the job.
    """
    rows = spark.read.schema(LABEL_RECORDS).option("mode", "FAILFAST").json(path)
    nothing = F.col("id").isNull() & F.col("label").isNull()
    return rows.where(_all_but(nothing, "a label record", F.to_json(F.struct("id", "label"))))


# One entry of {"target": {"123": "Yes", ...}}, with the wrapper's braces where the entry is first or last.
_PAIR = r'^[\s{]*(?:"[A-Za-z_]+"\s*:\s*\{)?\s*"([^"\\]*)"\s*:\s*"([^"\\]*)"[\s}]*$'
_NO_PAIR = r'^[\s{}]*(?:"[A-Za-z_]+"\s*:\s*\{)?[\s}]*$'
# Names of a record's columns; as keys they show that the file holds records.
_COLUMNS = ("id", "label")


def read_label_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Labels stored as one JSON object of id/label pairs, however large.

    The file is split at the commas, so that many tasks read parts of one object. Ids and labels
    hold no commas, quotes or braces; text that is not such a pair, and a record, fail the job instead of losing
    labels. Braces are counted first, to find an object that is cut off behind a pair.
    """
    pieces = spark.read.option("lineSep", ",").text(path)
    opened, closed = pieces.agg(*(F.sum(F.regexp_count("value", F.lit(brace))) for brace in (r"\{", r"\}"))).first()
    if opened != closed:
        raise ValueError(f"not an id/label pair: {opened or 0} braces are opened and {closed or 0} closed in {path}")
    entries = pieces.where(~F.col("value").rlike(_NO_PAIR))
    key = F.regexp_extract("value", _PAIR, 1)
    wrong = ~F.col("value").rlike(_PAIR) | key.isin(*_COLUMNS)
    return entries.where(_all_but(wrong, "an id/label pair", F.col("value"))).select(
        F.regexp_extract("value", _PAIR, 1).alias("id"), F.regexp_extract("value", _PAIR, 2).alias("label")
    )


# Text up to a closing brace: a record of an array, or what follows the last one.
_ARRAY_RECORD = r"^[\s\[,]*\{[^{}]*$"
_ARRAY_END = r"^[\s\]]*$"


def read_label_array(spark: SparkSession, path: str) -> DataFrame:
    """Labels stored as one JSON array of records per file, over one line or many, however large.

    The file is split at the closing braces, so that many tasks read parts of one array. Records are flat, and their
    texts hold no braces; anything else fails the job instead of losing labels. Brackets are counted first, to find an
    array that is cut off between two records.
    """
    pieces = spark.read.option("lineSep", "}").text(path)
    text = F.col("value")
    opened, closed = pieces.agg(F.count_if(text.rlike(r"^\s*\[")), F.count_if(text.rlike(r"^[^{]*\]\s*$"))).first()
    if opened != closed:
        raise ValueError(f"not a label record: of the arrays {opened} are opened and {closed} closed in {path}")
    records = pieces.where(~text.rlike(_ARRAY_END) & ~text.rlike(r"^\s*\[\s*\]\s*$"))
    checked = records.where(_all_but(~text.rlike(_ARRAY_RECORD), "a label record", text))
    # Null for what is no record, as the engine may parse before it filters.
    whole = F.when(text.rlike(_ARRAY_RECORD), F.concat(F.regexp_replace("value", r"^[\s\[,]+", ""), F.lit("}")))
    rows = checked.select(F.from_json(whole, LABEL_RECORDS, {"mode": "FAILFAST"}).alias("record"), text.alias("_text")).select("record.*", "_text")
    nothing = F.col("id").isNull() & F.col("label").isNull()
    return rows.where(_all_but(nothing, "a label record", F.col("_text"))).drop("_text")


LABEL_SHAPES = ("pairs", "records", "array")


def read_labels(spark: SparkSession, path: str, shape: str = "pairs") -> DataFrame:
    """Labels of one file shape: an object of ``pairs``, ``records`` by line, or an ``array`` over several lines.

    A folder that holds another shape fails.
    """
    if shape not in LABEL_SHAPES:
        raise ValueError(f"unknown label file shape {shape!r}; known: {LABEL_SHAPES}")
    return {"pairs": read_label_pairs, "records": read_label_records, "array": read_label_array}[shape](spark, path)


JSON_READERS = {"mcc_codes": read_code_map, "train_fraud_labels": read_labels}


def read_json(spark: SparkSession, name: str, path: str, **options) -> DataFrame:
    """Read a JSON dataset by its name; ``shape`` says how the labels are stored."""
    if name not in JSON_READERS:
        raise ValueError(f"unknown JSON dataset {name!r}; known: {sorted(JSON_READERS)}")
    return JSON_READERS[name](spark, path, **options)
