"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daybars.session import scratch_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# UTF-8 byte maps. A-Z is lower-cased and nothing else is; FOLD also turns
# every ASCII byte that is neither a letter nor a digit into a blank, so that
# ``split()`` yields the words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ .
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
FOLD = bytes(LOWER[b] if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only (``lower`` would also change other scripts)."""
    return F.translate(c, UPPER, UPPER.lower())


def words_of(text: str | None) -> list[bytes]:
    """The folded words of a text; null and empty texts have none."""
    return text.encode().translate(FOLD).split() if text else []


def tokens_of(text: str | None) -> list[bytes]:
    """Lower-cased runs without ASCII white space."""
    return text.encode().translate(LOWER).split() if text else []


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have yet (case-insensitive)."""
    taken = {c.lower() for c in df.columns}
    name, k = base, 0
    while name.lower() in taken:
        k += 1
        name = f"{base}_{k}"
    return name


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    Cuts the lineage and survives the loss of any executor: the files are in
    the folder that ``spark.checkpoint.dir`` names, not on an executor.
    """
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def placed(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``docs`` with two columns that say where each row is stored: a hash of
    the file and the row's number in it. They are the same in every pass and
    differ for equal rows. Rows that are not read from Parquet are written to the
    shared folder first."""
    file, row = fresh(docs, "_file"), fresh(docs, "_row")
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:
        docs = materialize(docs, "placed")
    return docs.withColumns({file: F.xxhash64("_metadata.file_path"), row: F.col("_metadata.row_index")}), [file, row]
