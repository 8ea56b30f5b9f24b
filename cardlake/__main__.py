"""Command line of the jobs: ``python -m cardlake <job> ...`` or through spark-submit.

JDBC properties, the password among them, are read from a JSON file, never from the command line.
"""

from __future__ import annotations

import argparse
import json
import logging
from datetime import date, datetime, timedelta
from pathlib import Path

from cardlake.operators.joins import FRAUD_VALUES
from cardlake.operators.quality import duplicate_codes
from cardlake.operators.sampling import class_balance
from cardlake.plans import adhoc, bronze, fraud, gold, silver
from cardlake.schemas import GOLD
from cardlake.session import build_session
from cardlake.sinks.relational import write_jdbc
from cardlake.sinks.versions import read_current
from cardlake.sources.files import LABEL_SHAPES, read_csv
from cardlake.sources.relational import DEFAULT_SIZE
from cardlake.sources.snapshots import half_snapshot, stamp

log = logging.getLogger("cardlake")


def _properties(path: str | None) -> dict[str, str]:
    return json.loads(Path(path).read_text()) if path else {}


def load_source(spark, args) -> None:
    """Fill the source table: half of the file as of yesterday, then all of it as of now."""
    rows = read_csv(spark, args.csv, args.schema, multiline=args.multiline)
    now = datetime.now()
    first, second = now - timedelta(days=1), now
    properties = _properties(args.jdbc_properties)
    for part, when, mode in ((half_snapshot(rows), first, "overwrite"), (rows, second, "append")):
        stamped = stamp(part, f"{when:%Y-%m-%d %H:%M:%S}")
        write_jdbc(stamped, args.jdbc_url, "transactions", properties, mode, args.connections)


def run_bronze(spark, args) -> None:
    if args.jdbc_url:
        if (args.start is None) != (args.end is None):
            raise ValueError("a window of ids needs both --start and --end")
        counts = bronze.ingest_transactions(
            spark,
            args.jdbc_url,
            _properties(args.jdbc_properties),
            args.bronze,
            window=None if args.start is None else (args.start, args.end),
            size=args.size,
            count=args.ranges,
            everything=args.everything,
            mode=args.mode,
        )
        log.info("transactions: %s", counts)
        if counts["n_outside"]:
            log.warning("%d transactions are outside the window and were not read", counts["n_outside"])
        if counts["n_held"]:
            log.info("%d transactions were loaded before", counts["n_held"])
    for name, path in (("cards", args.cards), ("users", args.users)):
        if path:
            log.info("%s: %d rows", name, bronze.ingest_csv(spark, name, path, args.bronze, args.day))
    for name, path, options in (
        ("mcc_codes", args.mcc_codes, {}), ("train_fraud_labels", args.labels, {"shape": args.labels_shape})
    ):
        if path:
            log.info("%s: %d rows", name, bronze.ingest_json(spark, name, path, args.bronze, args.day, **options))


def run_silver(spark, args) -> None:
    counts = silver.refresh_silver(spark, args.bronze, args.silver, args.mode, args.keep_other_days)
    log.info("rows written: %s", counts)
    repeated = duplicate_codes(gold.read_silver(spark, "mcc_codes", args.silver)).count()
    if repeated:
        log.warning("%d category codes are listed more than once", repeated)


def run_gold(spark, args) -> None:
    names = gold.refresh_gold(
        spark,
        args.gold,
        args.silver,
        jdbc_url=args.jdbc_url,
        jdbc_properties=_properties(args.jdbc_properties),
        connections=args.connections,
        fraud_values=tuple(args.fraud_values),
        count_per_label=args.count_per_label,
    )
    log.info("marts written: %s", names)


def run_train(spark, args) -> None:
    entities = ("transactions", "train_fraud_labels", "cards", "mcc_codes")
    tables = [gold.read_silver(spark, entity, args.silver) for entity in entities]
    training, test = fraud.prepare_training(
        *tables, tuple(args.fraud_values), args.seed, args.keep_one_in, args.train_percent
    )
    balance = {row["fraud_label"]: row["n_rows"] for row in class_balance(training.unionByName(test)).collect()}
    log.info("sample: %s", balance)
    log.info("missing numbers: %s", fraud.missing_features(training).first().asDict())
    parts = fraud.training_of(fraud.load(args.parts_of))["parts"] if args.parts_of else args.parts
    model = fraud.train(training, args.max_iter, args.max_bins, args.seed, args.handle_invalid, parts, args.rare)
    log.info("trained on: %s", fraud.training_of(model))
    log.info("AUC: %s", fraud.area_under_roc(fraud.score(model, test)))
    fraud.save(model, args.model)


def run_score(spark, args) -> None:
    rows = fraud.check_inputs(spark.read.parquet(args.input))
    scored = fraud.score(fraud.load(args.model), rows)
    scored.select(*rows.columns, "prediction", "fraud_probability").write.parquet(args.output)


def run_query(spark, args) -> None:
    adhoc.register_marts({name: read_current(spark, f"{args.gold}/{name}") for name in GOLD})
    _, path = adhoc.run_and_export(spark, args.sql, args.output)
    log.info("exported to %s", path)


def parse(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="cardlake", description=__doc__)
    parser.add_argument("--hive", action="store_true", help="use a Hive metastore for the catalog")
    parser.add_argument("--shuffle-partitions", default=None, help="upper width of a shuffle, coalesced at run time")
    jobs = parser.add_subparsers(dest="job", required=True)

    def job(name, action):
        sub = jobs.add_parser(name)
        sub.set_defaults(action=action)
        return sub

    load = job("load-source", load_source)
    load.add_argument("--csv", required=True)
    load.add_argument("--schema", help="DDL of the CSV columns; text columns when left out")
    load.add_argument("--jdbc-url", required=True)
    load.add_argument("--jdbc-properties")
    load.add_argument("--multiline", action="store_true", help="cells hold line breaks; the file is then one task")
    load.add_argument("--connections", type=int, help="most connections at a time; one per partition when left out")

    feed = job("bronze", run_bronze)
    feed.add_argument("--bronze", required=True)
    feed.add_argument("--day", type=date.fromisoformat, default=date.today(), help="ingestion day of the files")
    feed.add_argument("--jdbc-url")
    feed.add_argument("--jdbc-properties")
    feed.add_argument("--start", type=int, help="first id of a window; all ids are read when left out")
    feed.add_argument("--end", type=int, help="end of the window")
    feed.add_argument("--size", type=int, default=DEFAULT_SIZE, help="ids of a range")
    feed.add_argument("--ranges", type=int, help="number of ranges, instead of their size")
    feed.add_argument("--everything", action="store_true", help="also read the ids outside the window")
    feed.add_argument(
        "--mode", choices=("overwrite", "append"), default="overwrite",
        help="replace whole days, or add the ids that are not loaded yet",
    )
    for name in ("cards", "users", "mcc-codes", "labels"):
        feed.add_argument(f"--{name}")
    feed.add_argument("--labels-shape", choices=LABEL_SHAPES, default="pairs", help="how the label file is built")

    clean = job("silver", run_silver)
    clean.add_argument("--bronze", required=True)
    clean.add_argument("--silver", required=True)
    clean.add_argument("--mode", choices=("latest", "all"), default="latest")
    clean.add_argument("--keep-other-days", action="store_true", help="replace only the days that are written")

    mart = job("gold", run_gold)
    mart.add_argument("--gold", required=True)
    mart.add_argument("--silver", help="folder of the Silver tables; the catalog is used when left out")
    mart.add_argument("--jdbc-url")
    mart.add_argument("--jdbc-properties")
    mart.add_argument("--connections", type=int, help="most connections at a time; one per partition when left out")
    mart.add_argument("--count-per-label", action="store_true", help="region and category marts count once per label")
    mart.add_argument("--fraud-values", nargs="+", default=list(FRAUD_VALUES), help="labels that mean fraud")

    fit = job("train", run_train)
    fit.add_argument("--model", required=True)
    fit.add_argument("--silver", help="folder of the Silver tables; the catalog is used when left out")
    fit.add_argument("--max-iter", type=int, default=30)
    fit.add_argument("--max-bins", type=int, default=fraud.MAX_BINS)
    fit.add_argument("--handle-invalid", choices=("error", "skip", "keep"), default="error")
    fit.add_argument("--fraud-values", nargs="+", default=list(FRAUD_VALUES), help="labels that mean fraud")
    fit.add_argument("--seed", type=int, default=42)
    fit.add_argument("--keep-one-in", type=int, default=10, help="of the other transactions, one in so many is used")
    fit.add_argument("--train-percent", type=int, default=80)
    fit.add_argument("--rare", choices=("error", "fold"), default="error", help="what a column with more values than bins does")
    parts = fit.add_mutually_exclusive_group()
    parts.add_argument("--parts", type=int, help="parts of the training rows; by their number when left out")
    parts.add_argument("--parts-of", help="folder of a model whose number of parts is used again")

    rate = job("score", run_score)
    rate.add_argument("--model", required=True)
    rate.add_argument("--input", required=True)
    rate.add_argument("--output", required=True)

    query = job("query", run_query)
    query.add_argument("--gold", required=True)
    query.add_argument("--sql", required=True)
    query.add_argument("--output", required=True)
    return parser.parse_args(argv)


def main(argv: list[str] | None = None) -> None:
    logging.basicConfig(level=logging.WARNING, format="%(asctime)s - %(levelname)s - %(message)s")
    log.setLevel(logging.INFO)
    args = parse(argv)
    conf = {"spark.sql.shuffle.partitions": args.shuffle_partitions} if args.shuffle_partitions else {}
    spark = build_session(f"cardlake-{args.job}", conf, args.hive)
    try:
        args.action(spark, args)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
