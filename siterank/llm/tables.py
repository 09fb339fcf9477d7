"""Small helpers the operators of this folder share."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siterank.sources.tables import read_parquet

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

TEXT_KEYS = {"pages": "page_id", "documents": "doc_id"}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables; a small one of long texts is spread over the cores."""
    return read_parquet(spark, f"{folder}/{name}.parquet", TEXT_KEYS.get(name))


def unsigned_crc32(text: Column) -> Column:
    """CRC-32 of the UTF-8 bytes of a string column, null as the empty string."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def map_frames(df: DataFrame, make, schema: str, *args) -> DataFrame:
    """``mapInPandas`` with ``make(frame, *args) -> frame`` for every batch."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                yield make(frame, *args)

    return df.mapInPandas(run, schema)


def slices(frames: Iterator[pd.DataFrame], text: str, most: int = 16 << 20) -> Iterator[pd.DataFrame]:
    """The same rows in frames of about ``most`` characters each, however long the texts are."""
    for frame in frames:
        sizes = frame[text].str.len().fillna(0).cumsum()
        if len(frame) and sizes.iloc[-1] > most:
            for _, part in frame.groupby((sizes // most).to_numpy(), sort=False):
                yield part
        else:
            yield frame


def utf8(column: pa.Array):
    """The bytes of a string column and its offsets, without a copy; nulls are empty."""
    import numpy as np

    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    if column.null_count:
        column = column.fill_null("")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]
