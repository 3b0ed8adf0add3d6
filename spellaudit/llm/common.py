"""Small things that the operators share: reading tables, and tables written to the shared folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spellaudit.sources.corpus import stored

#: ASCII letters, for lower-casing that leaves all other letters as they are.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of a batch that goes to Python, where the session does not say: rows are whole texts, and a batch is held several times over.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch", "1000"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; the session's batches are kept small unless it has a size of its own for them."""
    if spark.conf.get(BATCH[0], None) is None:
        spark.conf.set(*BATCH)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def written(df: DataFrame, *, name: str = "step") -> DataFrame:
    """``df`` written once to the shared folder and read back: later steps start from whole files, whatever executor is lost."""
    return stored(df, name=name)


def values(*columns: pa.Array, at_once: int = 256) -> Iterator:
    """The values of a column (of several: tuples), taken out of Arrow a few at a time, as texts are large."""
    for at in range(0, len(columns[0]), at_once):
        some = [c.slice(at, at_once).to_pylist() for c in columns]
        yield from some[0] if len(some) == 1 else zip(*some, strict=True)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, which leaves no unused memory to its worker: workers are used again by other steps."""

    def lean_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return lean_run


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents_only(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (null: empty), besides the columns named; other columns of the input do not take part."""
    return docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def skewed_join(rows: DataFrame, groups: DataFrame, key: str | list[str], size: str, *, share: int = 1000, least: int = 1000) -> DataFrame:
    """``rows`` joined with ``groups``, which has each key once and the number of its rows in ``size``; both are read twice.

    A key with more than a ``share``-th of all those rows (and more than ``least``) is joined by broadcast, so its rows are not gathered
    in one task: fewer than ``share`` keys can have so many. All other keys are shuffled.
    """
    total = groups.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n"), F.coalesce(F.max(size), F.lit(0)).alias("most")).first()
    bound = max(total.n / share, least)
    if total.most <= bound:
        return rows.join(groups, key)
    hot = groups.filter(F.col(size) > bound)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(groups.filter(F.col(size) <= bound), key)
    return rows.join(F.broadcast(hot), key).unionByName(rest)
