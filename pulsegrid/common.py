"""Small helpers shared by every operator."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A parquet table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def need(df: DataFrame, *columns: str) -> DataFrame:
    """Keep only the named columns; a table without one of them is an error."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; the table has {df.columns}")
    return df.select(*columns)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage: the one the session names in ``spark.checkpoint.dir``.

    Where none is named, a session on this one machine (tests) gets a folder of its own; on a cluster that is an error, since
    a folder of one machine is lost with it.
    """
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    found = spark.conf.get("spark.checkpoint.dir", "") or context.getConf().get("spark.checkpoint.dir", "")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir names no folder that all machines of the cluster share")
        found = tempfile.mkdtemp(prefix="pulsegrid-ck-")
    context.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from what was written."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def blank(c: Column) -> Column:
    """True for null, empty and all-space text."""
    return c.isNull() | (F.trim(c) == "")


#: Letters that Unicode decomposition leaves alone, with their plain spelling. Fixed values.
LATIN_EXTRA = {"ß": "ss", "ł": "l", "Ł": "L", "ø": "o", "Ø": "O", "œ": "oe", "Œ": "OE", "æ": "ae", "Æ": "AE", "đ": "d", "Đ": "D", "ı": "i"}


def plain_letters(text: str) -> str:
    """Text without accents: ``é`` becomes ``e``, ``ł`` becomes ``l``, ``ß`` becomes ``ss``."""
    import unicodedata

    for a, b in LATIN_EXTRA.items():
        text = text.replace(a, b)
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def string_field(name: str) -> T.StructField:
    return T.StructField(name, T.StringType())


def data_dir() -> str:
    return os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")


def local_if_small(df: DataFrame, bound: int) -> DataFrame:
    """``df`` as a relation of known size where it has at most ``bound`` rows, else ``df`` itself.

    Spark then broadcasts it by its own size check, so a big fact table is neither shuffled nor skewed by the join; a
    table beyond the bound stays distributed and the join becomes an ordinary one.
    """
    rows = df.limit(bound + 1).toArrow()
    if rows.num_rows > bound:
        return df
    return df.sparkSession.createDataFrame(rows, df.schema)


def settle(df: DataFrame) -> DataFrame:
    """Keep the columns computed so far from being copied into every later expression that uses them.

    Catalyst merges neighbouring projections; a long chain of text rules would then be evaluated again for each use and
    outgrow code generation. A one-element generator between them ends that, at the price of one copy of the row.
    """
    return df.select("*", F.explode(F.array(F.lit(0))).alias("_settled")).drop("_settled")


class Memo:
    """A function that keeps its results, up to a number of them; it travels to the executors without what it keeps."""

    def __init__(self, function, size: int = 100_000) -> None:  # noqa: ANN001
        self.function, self.size, self.kept = function, size, {}

    def __call__(self, *args):  # noqa: ANN002, ANN204
        try:
            return self.kept[args]
        except KeyError:
            if len(self.kept) >= self.size:
                self.kept.clear()
            out = self.kept[args] = self.function(*args)
            return out

    def __getstate__(self) -> tuple:
        return self.function, self.size

    def __setstate__(self, state: tuple) -> None:
        self.function, self.size = state
        self.kept = {}
