"""Small helpers shared by the operators of this folder."""
from __future__ import annotations

import os
import sys
import types
import uuid
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from soilcast.session import cut_lineage, ensure_checkpoint_dir
from soilcast.sources.readings import table

__all__ = ["WORD", "SPACE", "SPACE_CHARS", "cut_lineage", "dealt_shards", "file_system", "fresh", "id_key", "let", "row_hash", "run_folder",
           "ship", "table", "text_or_empty", "words", "worker_state", "written"]

# A word of every contract: a run of characters outside space and the ASCII controls 9-13.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def ship(module: str) -> None:
    """Pickle a module's functions by value, so executors need no copy of this repository."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


ship(__name__)


def worker_state(name: str) -> dict:
    """A dictionary that lives as long as the Python worker (functions are pickled by value, so their own
    globals are new in every task)."""
    key = "_soilcast_worker_state"
    mod = sys.modules.get(key)
    if mod is None:
        mod = sys.modules[key] = types.ModuleType(key)
    return mod.__dict__.setdefault(name, {})


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def words(text: Column) -> Column:
    """The words of a text as an array (empty for a null or blank text)."""
    return F.array_remove(F.split(text, SPACE), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that clash with no column of ``df`` (names compare without case)."""
    have = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in have:
            n = f"_{n}"
        have.add(n.lower())
        out.append(n)
    return out


def row_hash(df: DataFrame, *columns: str) -> Column:
    """A 64-bit hash of a row; a null and an empty value differ."""
    cols = columns or tuple(df.columns)
    parts = [p for c in cols for p in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]
    return F.xxhash64(*parts)


def id_key(col: str | Column) -> Column:
    """Join key of an id that may be null: null joins null through its own flag."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c, F.lit(-1).cast("long"))


def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder for one run below the shared folder the cluster names in ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: cuts the lineage, and, unlike a checkpoint, forgets
    the partitioning, so that a later join deals both sides itself and can split a skewed key."""
    path = run_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt_shards(manifest: DataFrame, key: str = "shard", most: int = 20_000) -> DataFrame:
    """A manifest dealt out over as many tasks as it has rows (``most`` at most). The number is explicit: a few bytes a
    row would otherwise be put back together into one task, which would then read every shard."""
    return manifest.repartition(max(1, min(most, manifest.count())), F.col(key))


def file_system(uri: str):
    """(pyarrow file system, path in it) of a URI or a plain path, for use inside tasks."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else os.path.abspath(uri))
