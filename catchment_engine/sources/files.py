"""CSV, YAML, text and environment, and a sink that changes nothing unless told to."""

from __future__ import annotations

import csv
import io
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .. import schemas
from ..schemas import World


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV file with a header under a declared schema; a missing file fails at once."""
    return spark.read.csv(path, schema=schema, header=True, mode="FAILFAST", enforceSchema=False)


def write_csv(df: DataFrame, path: str) -> None:
    """Nested columns have no place in CSV and are left out."""
    plain = [f.name for f in df.schema if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    df.select(*plain).write.mode("overwrite").csv(path, header=True)


def read_world(spark: SparkSession, folder: str) -> World:
    return World(
        read_csv(spark, f"{folder}/providers.csv", schemas.PROVIDERS),
        read_csv(spark, f"{folder}/tracts.csv", schemas.TRACTS),
        read_csv(spark, f"{folder}/travel_times.csv", schemas.TRAVEL_TIMES),
        {"folder": folder},
    )


def read_manifest(path: str) -> dict:
    import yaml

    return yaml.safe_load(Path(path).read_text())


def setting(name: str, default: str) -> str:
    """An environment variable, or a default where it is unset or empty."""
    return os.environ.get(name) or default


def append_line(path: str, line: str) -> None:
    with open(path, "a") as f:
        f.write(line + "\n")


class GoldenStore:
    """Small expected tables as CSV. write() returns the differences and touches nothing
    unless accept is set; lines beginning with an ignored prefix don't count."""

    def __init__(self, folder: str, ignore: tuple[str, ...] = ("created:",)):
        self.folder, self.ignore = Path(folder), ignore

    def render(self, df: DataFrame, order: list[str]) -> str:
        rows = df.orderBy(*order).collect()  # golden tables are a few rows by definition
        out = io.StringIO()
        w = csv.writer(out, lineterminator="\n")
        w.writerow(df.columns)
        w.writerows([["" if v is None else repr(v) if isinstance(v, float) else v for v in r] for r in rows])
        return out.getvalue()

    def _lines(self, text: str) -> list[str]:
        return [x for x in text.splitlines() if not x.startswith(self.ignore)]

    def write(self, name: str, text: str, accept: bool = False) -> list[tuple[int, str | None, str | None]]:
        path = self.folder / name
        old, new = self._lines(path.read_text()) if path.exists() else [], self._lines(text)
        width = max(len(old), len(new))
        pairs = zip(range(1, width + 1), old + [None] * (width - len(old)), new + [None] * (width - len(new)), strict=True)
        changed = [(i, a, b) for i, a, b in pairs if a != b]
        if changed and accept:
            self.folder.mkdir(parents=True, exist_ok=True)
            path.write_text(text)
        return changed
