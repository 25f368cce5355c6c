"""What the jobs' command lines share: a small JSON file of settings, overridden by options, and a log."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def settings(argv: list[str] | None, doc: str, defaults: dict[str, object]) -> dict[str, object]:
    """``--config FILE`` and an option for each setting; options count before the file, the file before the defaults."""
    p = argparse.ArgumentParser(description=doc)
    p.add_argument("--config", help="a JSON file of settings on this machine")
    for name, value in defaults.items():
        p.add_argument(f"--{name}", type=type(value) if value is not None else str)
    given = vars(p.parse_args(argv))
    chosen = dict(defaults)
    if path := given.pop("config"):
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        if unknown := set(said) - set(defaults):
            raise ValueError(f"{path}: unknown settings {sorted(unknown)}")
        chosen |= said
    chosen |= {k: v for k, v in given.items() if v is not None}
    if missing := [k for k, v in chosen.items() if v is None]:
        raise ValueError(f"missing settings: {missing}")
    return chosen


def counted(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """``df``, and its number of rows once it has been written."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def main(run: Callable[..., object], argv: list[str] | None, doc: str, defaults: dict[str, object]) -> int:
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    chosen = settings(argv, doc, defaults)
    spark = SparkSession.builder.appName(run.__module__).getOrCreate()
    try:
        run(spark, **chosen)
    finally:
        spark.stop()
    return 0
