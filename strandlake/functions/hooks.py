"""User function hooks: map, aggregate, expand. Functions work on pandas or Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def map_reads(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema=None) -> DataFrame:
    """fn gets batches of rows (or pairs in one row) and returns the rows to keep, changed or not."""
    return df.mapInPandas(lambda batches: (fn(b) for b in batches), schema or df.schema)


def udaf(df: DataFrame, keys: list[str], add: Callable, merge: Callable, finish: Callable, schema: str, parts: int = 16) -> DataFrame:
    """A user aggregate in two phases: add(frame) gives a bytes state for each key and part, merge(list of states) and
    finish(state) a row. Parts split hot keys before states meet."""
    import pickle

    names = ", ".join(f"{k} {dict(df.dtypes)[k]}" for k in keys)
    split = df.withColumn("__part", F.pmod(F.monotonically_increasing_id(), F.lit(parts)))

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "state": [pickle.dumps(add(pdf))]})

    def second(pdf: pd.DataFrame) -> pd.DataFrame:
        done = finish(merge([pickle.loads(s) for s in pdf["state"]]))
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, **{c: [v] for c, v in done.items()}})

    partial = split.groupBy(*keys, "__part").applyInPandas(first, f"{names}, state binary")
    return partial.groupBy(*keys).applyInPandas(second, f"{names}, {schema}")


def flat_map(df: DataFrame, fn: Callable[[dict], list[dict]], schema: str) -> DataFrame:
    """fn gives any number of rows for a row."""

    def run(batches):
        for b in batches:
            rows = [r for d in b.to_dict("records") for r in fn(d)]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")])

    return df.mapInPandas(run, schema)
