"""Vector tables as packed blocks: one row holds the ids and the matrix of a bounded number of vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PACK = "ids binary, data binary"


def usable(vector: Column) -> Column:
    """True for vectors that are not null and hold neither null nor non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def padded(vector: Column, dims: int) -> Column:
    """The vector with zeros up to ``dims`` components."""
    return F.concat(vector, F.array_repeat(F.lit(0).cast("float"), F.greatest(F.lit(dims) - F.size(vector), F.lit(0))))


def named(rows: DataFrame) -> DataFrame:
    """The rows with an id: a vector without one can be neither asked for nor named as a neighbour."""
    return rows.where(F.col("id").isNotNull())


def dealt_to(blocks: int) -> Column:
    """The block of a row (id, vector, salt): rows of one id, or repeated ones, go to different blocks."""
    return F.pmod(F.xxhash64("id", "vector", "salt"), F.lit(blocks).cast("long"))


def pack(df: DataFrame, by: list[str], kind: str) -> DataFrame:
    """``by`` columns, ``ids`` and ``data``: each group's ids and vectors (columns id, vector), ascending by id.

    ``salts`` holds their row numbers likewise, if there is a column salt. The caller bounds the groups' sizes.
    """
    types = dict(df.dtypes)
    salt = ["salt"] if "salt" in types else []

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id", kind="stable")
        data = np.stack(rows["vector"].to_list()).astype(kind) if len(rows) else np.zeros((0, 0), kind)
        return pd.DataFrame({**{c: [k] for c, k in zip(by, key, strict=True)},
                             "ids": [rows["id"].to_numpy("<i8").tobytes()], "data": [data.tobytes()],
                             **{"salts": [rows[c].to_numpy("<i8").tobytes()] for c in salt}})

    schema = ", ".join([*(f"{c} {types[c]}" for c in by), PACK, *(["salts binary"] if salt else [])])
    return df.select(*by, "id", "vector", *salt).groupBy(*by).applyInPandas(one, schema)


def unpack(ids: bytes, data: bytes, kind: str, dims: int) -> tuple[np.ndarray, np.ndarray]:
    names = np.frombuffer(ids, "<i8")
    return names, np.frombuffer(data, kind).reshape(len(names), dims)


def best(df: DataFrame, k: int, order: list[Column]) -> DataFrame:
    """The first ``k`` rows of each query by ``order``, with ``rank`` from 1."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= k)
