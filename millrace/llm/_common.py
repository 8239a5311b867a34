"""What the operators of this subpackage share: tables that cut lineage, sizes and the hold-out rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import cut, shared_path

#: A table in the shared folder, written and read again, that cuts the lineage.
checkpoint = cut
#: A new path in the shared folder for a table that an operator writes and rereads.
fresh_path = shared_path


def fold(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """crc32 of the id as text, modulo folds; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


def held_out(doc_id: str = "doc_id") -> Column:
    """True for ids of fold 0; a null id is in no fold and never held out."""
    return F.coalesce(fold(doc_id) == 0, F.lit(False))


def unit_hash(*columns: str) -> Column:
    """A number from 0 to 1 from a hash of these columns."""
    return F.pmod(F.xxhash64(F.lit(17), *columns), F.lit(1 << 30)) / float(1 << 30)


def bounded_sample(rows: DataFrame, stratum: str, per_stratum: int, order: str = "doc_id") -> DataFrame:
    """Rows of each stratum, about per_stratum of them at most, chosen by a hash of `order`.

    The sampling rate of a stratum follows from its exact count, so the expected size is bounded
    whatever the input. Only one row per stratum goes to the driver.
    """
    counts = rows.groupBy(stratum).count().collect()
    rate = F.lit(0.0)
    for row in counts:
        share = min(1.0, per_stratum / row["count"])
        rate = F.when(F.col(stratum).eqNullSafe(F.lit(row[stratum])), F.lit(share)).otherwise(rate)
    return rows.filter(unit_hash(order) < rate)


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of UTF-8 in a text column; sizes partitions, never selects rows."""
    return docs.agg(F.sum(F.octet_length(column)).alias("n")).first()["n"] or 0
