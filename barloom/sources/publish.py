"""Loads that are whole or fail: rows are checked while they are written to a staged folder, which is renamed only if none is faulty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..operators.validate import load_faults
from .workdir import new_dir


class LoadRejected(ValueError):
    """A load had faulty rows, or none at all; nothing of it was published."""


def _files(df: DataFrame, path: str):
    jvm = df.sparkSession._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()), at


def load_whole(bars: DataFrame, *rules: tuple[str, Column], to: str | None = None, least: int = 0) -> DataFrame:
    """``bars``, published: all of them, or none and ``LoadRejected``.

    Every row is checked by ``rules``, the row rules and for a repeated key, in the one job that writes it, so no filter, limit or choice of
    columns on what is returned can pass a faulty row by. Fewer than ``least`` rows are rejected too. ``to`` is where the table is published, which must not be
    there yet; without it, a new place in the shared folder. A job that fails, or a driver that is lost, leaves at most the staged folder beside
    it, which no reader is given. The last step is one rename: at once on file systems that rename folders at once."""
    to = (to or new_dir(bars.sparkSession, "loaded")).rstrip("/")
    files, goal = _files(bars, to)
    if files.exists(goal):
        raise LoadRejected(f"already published: {to}")
    head, _, name = to.rpartition("/")
    staged_path = f"{head}/.{name}.{new_dir(bars.sparkSession, 'staged').rsplit('/', 2)[1]}"
    _, staged = _files(bars, staged_path)
    seen = Observation()
    bad = F.col("reason").isNotNull()
    first = F.min(F.when(bad, F.concat_ws(" ", "reason", "symbol", F.col("trading_date").cast("string"))))
    checked = load_faults(bars, *rules).observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(bad).alias("faulty"), first.alias("first"))
    published = False
    try:
        checked.select([c for c in bars.columns if not c.startswith("_")]).write.parquet(staged_path)
        found = seen.get
        if found["faulty"]:
            raise LoadRejected(f"load rejected: {found['faulty']} faulty rows, such as {found['first']}")
        if found["rows"] < least:
            raise LoadRejected(f"load rejected: {found['rows']} rows inside the requested range")
        published = files.rename(staged, goal)
        if not published:
            raise LoadRejected(f"could not be published: {to}")
    finally:
        if not published:
            files.delete(staged, True)
    return bars.sparkSession.read.parquet(to)
