"""Ranks, running sums and exact quantiles over ranges: no group, however large, passes through one task.

Equal values are counted first (with partial sums, so a hot value is one row), the distinct ones are range-partitioned and sorted, and each
range sums on its own; what ranges before it hold of the same group is one number a range, added in a second pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from countloom.session import cut

_OWN = ("range_", "run_")


def _changes(now: pa.Array, before) -> np.ndarray:
    """Where a column differs from the row before it (``before``: the value before the first), nulls being equal."""
    prior = pa.concat_arrays([pa.array([before], now.type), now.slice(0, len(now) - 1)])
    differ = pc.fill_null(pc.not_equal(now, prior), False).to_numpy(zero_copy_only=False)
    return differ | (now.is_null().to_numpy(zero_copy_only=False) != prior.is_null().to_numpy(zero_copy_only=False))


def cumulative(counts: DataFrame, by: list[str], order: list[str], sums: list[str]) -> DataFrame:
    """``counts`` with ``before_<s>`` for each of ``sums``: the sum over the rows of the same ``by`` that stand before, in ``order``.

    ``by`` and ``order`` together should tell rows apart (rows that do not are in one range, in any order). Columns of ``by`` and ``order`` may be null, which comes first;
    null sums count as 0. Two scans of the sorted table; the driver holds two rows a range.
    """
    spark = counts.sparkSession
    names, made = counts.columns, [f"before_{s}" for s in sums]
    kinds = {s: np.float64 if isinstance(counts.schema[s].dataType, (T.DoubleType, T.FloatType)) else np.int64 for s in sums}
    spark_kind = {np.float64: T.DoubleType(), np.int64: T.LongType()}
    schema = T.StructType([*counts.schema.fields, *(T.StructField(c, spark_kind[kinds[s]]) for c, s in zip(made, sums)), *(T.StructField(c, T.LongType()) for c in _OWN)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, run_no, last, total = TaskContext.get().partitionId(), -1, None, {s: 0 for s in sums}
        for batch in batches:
            if not batch.num_rows:
                continue
            at = {c: batch.column(i) for i, c in enumerate(names)}
            first = np.zeros(batch.num_rows, bool)
            for c, before in zip(by, last or [None] * len(by)):
                first |= _changes(at[c], before)
            if last is None:
                first[0] = True
            starts = np.flatnonzero(first)
            runs = run_no + np.cumsum(first)
            own = []
            for s in sums:
                x = pc.fill_null(at[s], 0).to_numpy(zero_copy_only=False).astype(kinds[s])
                ends = np.cumsum(x)
                base = np.zeros(len(x), kinds[s])  # what the batch holds before each run of equal groups
                base[starts] = np.diff(np.concatenate(([0], (ends - x)[starts])))
                carry = np.where(runs == run_no, total[s], 0)
                own.append((ends - x) - np.cumsum(base) + carry)
                total[s] = own[-1][-1] + x[-1]
            run_no, last = int(runs[-1]), [at[c][-1].as_py() for c in by]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, own), pa.array(np.full(len(runs), part)), pa.array(runs)], names=schema.names)

    ranged = cut(counts.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).mapInArrow(run, schema), "ranges")

    ends = ranged.groupBy("range_").agg(F.max("run_").alias("last_"))
    total = [F.coalesce(F.sum(s), F.lit(0)).alias(m) for m, s in zip(made, sums)]
    edge = ranged.join(F.broadcast(ends), "range_").where("run_ = 0 OR run_ = last_").groupBy("range_", "run_").agg(*(F.first(c).alias(c) for c in by), *total)
    carry, offsets = (None, None), []
    rows: dict[int, list] = {}
    for r in edge.orderBy("range_", "run_").collect():
        rows.setdefault(r["range_"], []).append(r)
    for part, found in sorted(rows.items()):
        key = tuple(found[0][c] for c in by)
        offset = carry[1] if carry[0] == key else [0] * len(sums)
        if any(offset):
            offsets.append((part, 0, *offset))
        through = offset if len(found) == 1 else [0] * len(sums)
        carry = tuple(found[-1][c] for c in by), [found[-1][m] + t for m, t in zip(made, through)]
    if not offsets:
        return ranged.drop(*_OWN)
    kind = ", ".join(f"more_{m} {'double' if kinds[s] is np.float64 else 'long'}" for m, s in zip(made, sums))
    more = spark.createDataFrame([tuple(float(x) if i > 1 and kinds[sums[i - 2]] is np.float64 else x for i, x in enumerate(o)) for o in offsets], f"range_ long, run_ long, {kind}")
    joined = ranged.join(F.broadcast(more), list(_OWN), "left")  # a row a range at most
    return joined.select(*names, *((F.col(m) + F.coalesce(F.col(f"more_{m}"), F.lit(0))).alias(m) for m in made))


def value_counts(df: DataFrame, by: list[str], value: str, sums: dict | None = None) -> DataFrame:
    """(by, value, n and ``sums``) of the distinct values, null ones left out."""
    return df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"), *(F.sum(c).alias(k) for k, c in (sums or {}).items()))


def ranks(df: DataFrame, by: list[str], value: str, sums: dict | None = None) -> DataFrame:
    """(by, value, n, before, rank, ...) of the distinct values: how many rows are smaller, and the average rank of ties from 1."""
    out = cumulative(value_counts(df, by, value, sums), by, [value], ["n"]).withColumnRenamed("before_n", "before")
    return out.withColumn("rank", F.col("before") + (F.col("n") + 1) / 2)


def average_ranks(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """``df`` (rows whose value is not null) with ``rank``, 1 for the smallest, ties averaged; NaN is the largest."""
    return _joined(df, ranks(df, by, value).select(*by, value, "rank"), [*by, value])


def _joined(df: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """An inner join on keys that may be null."""
    other = table.select(*(F.col(k).alias(f"{k}_r_") for k in keys), *(c for c in table.columns if c not in keys))
    on = None
    for k in keys:
        one = df[k].eqNullSafe(other[f"{k}_r_"])
        on = one if on is None else on & one
    return df.join(other, on).drop(*(f"{k}_r_" for k in keys))


def numbered(df: DataFrame, by: list[str], order: list[str], name: str = "number") -> DataFrame:
    """``df`` with its places from 0 within ``by`` in ``order``."""
    return cumulative(df.withColumn(name, F.lit(1).cast("long")), by, order, [name]).drop(name).withColumnRenamed(f"before_{name}", name)


#: Rows up to which a map of all distinct values may be held by one task (about 100 MB).
FEW = 1_000_000


def quantiles(df: DataFrame, by: list[str], value: str, qs: list[float], names: list[str] | None = None, *, rows: int | None = None) -> DataFrame:
    """(by, a column for each of ``qs``): exact quantiles, interpolated between neighbours as ``percentile`` does; nulls are left out.

    Of the sorted distinct values only those around the wanted places go on to be grouped: two for each group and q. Where the caller
    knows a bound of the ``rows`` within FEW, the built-in function does the same in one aggregation. Without ``by`` an empty table gives one row of nulls.
    """
    names = names or [f"q{i + 1}" for i in range(len(qs))]
    if rows is not None and rows <= FEW:
        found = df.groupBy(*by).agg(F.percentile(value, F.lit([float(q) for q in qs])).alias("q_"))
        return found.select(*by, *(F.col("q_")[i].alias(n) for i, n in enumerate(names)))
    held = cumulative(value_counts(df, by, value), by, [value], ["n"])
    size = held.groupBy(*by).agg(F.max(F.col("before_n") + F.col("n")).alias("size_"))
    if by:
        near = _joined(held, size, by)
    else:
        near = held.crossJoin(F.broadcast(size))  # one row
    wanted = F.array(*(F.struct(F.lit(i).alias("i"), (F.lit(float(q)) * (F.col("size_") - 1)).alias("at")) for i, q in enumerate(qs)))
    near = near.withColumn("w_", F.explode(wanted)).withColumn("low_", F.floor("w_.at")).withColumn("high_", F.ceil("w_.at"))
    inside = lambda at: (F.col(at) >= F.col("before_n")) & (F.col(at) < F.col("before_n") + F.col("n"))
    near = near.where(inside("low_") | inside("high_"))
    low, high = (F.max(F.when(inside(at), F.col(value).cast("double"))) for at in ("low_", "high_"))
    each = near.groupBy(*by, F.col("w_.i").alias("i_")).agg(low.alias("l_"), high.alias("h_"), F.first(F.col("w_.at") - F.col("low_")).alias("f_"))
    mid = F.when(F.col("f_") == 0, F.col("l_")).otherwise((1 - F.col("f_")) * F.col("l_") + F.col("f_") * F.col("h_"))
    return each.groupBy(*by).agg(*(F.max(F.when(F.col("i_") == i, mid)).alias(n) for i, n in enumerate(names)))
