"""Factloom: immutable, time-aware facts queried with Datalog, pull and SQL, all on Spark DataFrames."""

from __future__ import annotations

from pathlib import Path


def on_workers(spark) -> None:
    """Lets Python workers of this session import the package from where the driver has it (a cluster job ships it with --py-files)."""
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parent.parent)
    paths = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if root not in paths:
        env["PYTHONPATH"] = ":".join([root, *paths])
