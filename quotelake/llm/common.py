"""Small helpers of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Words are what stands between ASCII white space.
WORD_SPLIT = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z only; other letters keep their case."""
    return F.translate(text, UPPER, LOWER)


_LOWER_MAP = str.maketrans(UPPER, LOWER)


def lower_ascii_text(text: str) -> str:
    """Python side of :func:`lower_ascii`."""
    return text.lower() if text.isascii() else text.translate(_LOWER_MAP)


_OTHER_SPACES = str.maketrans("\t\n\x0b\x0c\r", "     ")


def words_of(text: str | None) -> list[str]:
    """Maximal runs without ASCII white space, as :data:`WORD_SPLIT` separates them."""
    if not text:
        return []
    return [w for w in text.translate(_OTHER_SPACES).split(" ") if w]


def fold_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo: the fold of a document."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus
