"""Streams: new rows folded into a fit, and running quality counters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from countloom.operators.scaling import VECTOR_LIMIT


def fold_in_stream(rows: DataFrame, v: DataFrame, n_cols: int) -> DataFrame:
    """Scaled rows of a stream of (row_id, cells array<struct<col_id, value>>): a stateless projection in append mode.

    ``v`` is the frozen table (col_id, v) of a fit: at most VECTOR_LIMIT scalers, which are broadcast as two arrays (more raise). A
    row's scaler comes from its own cells; cells of columns that the fit does not know become 0, and a row without others has a null scaler.
    """
    held = v.select("col_id", F.col("v").cast("double").alias("v")).limit(VECTOR_LIMIT + 1).toArrow().combine_chunks()
    if held.num_rows > VECTOR_LIMIT:
        raise ValueError(f"more than {VECTOR_LIMIT} scalers")
    names, scalers = (held.column(c).combine_chunks() for c in ("col_id", "v"))
    names, scalers = (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in (names, scalers))
    both = rows.sparkSession.sparkContext.broadcast((names, np.append(scalers.to_numpy(zero_copy_only=False), 0.0)))  # the last: unknown columns
    cell = rows.schema["cells"].dataType.elementType
    out = T.StructType([rows.schema["row_id"], T.StructField("u", T.DoubleType()), T.StructField("cells", T.ArrayType(T.StructType([cell["col_id"], T.StructField("value", T.DoubleType())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, scalers = both.value
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten()
            columns, values = (pc.struct_field(flat, c) for c in ("col_id", "value"))
            at = pc.fill_null(pc.index_in(columns.cast(names.type), names), len(scalers) - 1).to_numpy(zero_copy_only=False)
            x = pc.fill_null(values.cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False)
            lens = pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            owner = np.repeat(np.arange(len(lens)), lens)
            total = np.bincount(owner, x * scalers[at], len(lens))
            with np.errstate(divide="ignore", invalid="ignore"):
                u = np.where(total != 0, n_cols / total, np.nan)
                scaled = x * np.sqrt(u[owner]) * np.sqrt(scalers[at])
            some = lambda z: pa.array(z, pa.float64(), mask=np.isnan(z))
            cells = pa.StructArray.from_arrays([columns, some(scaled)], names=["col_id", "value"])
            offsets = pa.array(np.concatenate(([0], np.cumsum(lens))), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), some(u), pa.ListArray.from_arrays(offsets, cells)], names=["row_id", "u", "cells"])

    return rows.select("row_id", "cells").mapInArrow(run, out)


def counters(events: DataFrame, *, time: str = "ts", row: str = "user_id", col: str = "event_type", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Totals and counts by column of each row and window; late events up to the watermark still count."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), row, col).agg(F.count("*").alias("total"))
