"""What the stateful streams share: their state store, their order of events, and their state as a table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: transformWithState keeps its variables in this store.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stored_in_rocks(spark: SparkSession) -> None:
    """Streams that start from here on keep their state in the store that transformWithState needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def in_order(rows: Iterator[pd.DataFrame], columns: tuple[str, ...], then: str) -> Iterator[tuple]:
    """(micros, *columns) of a key's events, by time and then by a column.

    Frames are read one after the other and only these columns of them kept, as arrays: what a key holds at once is that
    of a micro-batch, which the source's options bound.
    """
    parts = [(f["ts"].to_numpy().astype("datetime64[us]").astype("i8"), *(f[c].to_numpy() for c in columns)) for f in rows]
    if parts:
        micros, *others = (np.concatenate(p) for p in zip(*parts, strict=True))
        for i in np.lexsort((others[columns.index(then)], micros)):
            yield (int(micros[i]), *(o[i] for o in others))


def state_of(spark: SparkSession, checkpoint: str, variable: str) -> DataFrame:
    """A variable of a stream's state as the stream's last commit left it: the grouping key's columns, then the variable's."""
    read = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", variable)
    rows = read.load()
    kind = rows.schema["value"].dataType if "value" in rows.columns else None
    own = [F.col(f"value.{f.name}") for f in kind.fields] if kind is not None else [F.col("list_element.*")]
    return rows.select("key.*", *own)
