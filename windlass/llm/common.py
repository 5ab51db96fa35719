"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Collection

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from windlass.functions.lineage import checkpoint_folder, cut, delete_folder, landed  # noqa: F401

#: A word is a run of anything but ASCII white space (Java and Python agree on this class).
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only, as ``bytes.lower`` does."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id is the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def keeping(docs: DataFrame, own: Collection[str], body: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``body(docs)`` with the columns of ``docs`` and no others: those that share a name with
    the operator's ``own`` columns stand aside under another name meanwhile."""
    aside = {c: f"_aside_{k}" for k, c in enumerate(docs.columns) if c.lower() in own or c.startswith("_")}
    made = body(docs.withColumnsRenamed(aside))
    return made.select(*[F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns])
