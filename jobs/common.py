"""What the jobs share: config files, named inputs, logging, the command line."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger("jobs")


def load_config(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def inputs(spark: SparkSession, config: dict, folder: str) -> dict[str, DataFrame]:
    """The tables that config["tables"] names: {name: {"path": below folder, "format": parquet, "options": {}}}."""
    found = {}
    for name, t in config["tables"].items():
        path = f"{folder.rstrip('/')}/{t['path']}"
        found[name] = spark.read.format(t.get("format", "parquet")).options(**t.get("options", {})).load(path)
        log.info("reading %s from %s", name, path)
    return found


def checked(config: dict, known: str) -> dict:
    """config, if it has no other keys than known (names with spaces between)."""
    if other := set(config) - set(known.split()) - {"spark", "tables"}:
        raise ValueError(f"unknown in the config: {', '.join(sorted(other))}; known: {known}, tables, spark")
    return config


def watched(df: DataFrame, what: str) -> tuple[DataFrame, Observation]:
    """df, and an observation that counts its rows (n) when it is first run: no scan of its own."""
    seen = Observation(what)
    return df.observe(seen, F.count(F.lit(1)).alias("n")), seen


def rows_seen(seen: Observation) -> int:
    """The count of an observation that has run; 0 where Spark saw beforehand that there are no rows, and observed none."""
    try:
        return seen.get["n"]
    except Py4JJavaError:
        return 0


def asked(spark: SparkSession, sql: str | list[str], tables: dict[str, DataFrame]) -> DataFrame:
    """The rows of a config's SQL (a text, or its lines), in which {name} stands for a table."""
    return spark.sql(sql if isinstance(sql, str) else "\n".join(sql), **tables)


def command_line(doc: str, run: Callable, paths: dict[str, str], default_config: str) -> None:
    """Parse --config and a path for each of paths, make a session, run(spark, config, **paths), stop the session."""
    parser = argparse.ArgumentParser(description=doc, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("--config", default=default_config, help="JSON file (default: %(default)s)")
    for name, text in paths.items():
        parser.add_argument(f"--{name}", required=True, help=text)
    args = vars(parser.parse_args())
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(name)s %(message)s")
    config = load_config(args.pop("config"))
    builder = SparkSession.builder.appName(run.__module__)
    for key, value in config.get("spark", {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    try:
        run(spark, config, **args)
    finally:
        spark.stop()
