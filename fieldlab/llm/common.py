"""What the operators share: reading inputs, hold-out folds, words."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

WORD_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # what separates words once A-Z are lower-cased
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_LOWERED = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_WORDS_ONLY = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in _LOWERED)


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def held_out(doc_id: Column) -> Column:
    """The fold that nothing is learned from. A row without id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(True))


def words_of(text: str) -> list[bytes]:
    """Lower-cased ASCII alphanumerics and everything beyond ASCII, as UTF-8 words."""
    return text.encode().translate(_WORDS_ONLY).split()


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def per_row(df: DataFrame, schema: str, columns: list[str], work: Callable[[pd.DataFrame], pd.DataFrame], unread: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """`columns` of df, 500 rows at a time through `work`. Whole numbers stay whole where some are null. `unread` columns are passed to
    the task and no further, for a plan that is to keep them.
    """

    target = to_arrow_schema(StructType.fromDDL(schema))

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for start in range(0, batch.num_rows, 500):
                frame = batch.slice(start, 500).select(columns).to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)
                yield pa.RecordBatch.from_pandas(work(frame), schema=target, preserve_index=False)

    return df.select(*columns, *unread).mapInArrow(batches, schema)


def carried(columns: tuple[str, ...]) -> Column:
    """Other columns of a row in one struct, so that their names clash with nothing."""
    return F.struct(F.lit(0).alias("_"), *[F.col(c) for c in columns]).alias("carried")


def carried_type(rows: DataFrame) -> str:
    return f"carried {rows.schema['carried'].dataType.simpleString()}"


def uncarried(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    own = [c for c in rows.columns if c != "carried"]
    return rows.select(*own, *[F.col("carried")[c].alias(c) for c in columns if c not in own])
