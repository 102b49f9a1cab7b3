"""Folds over rows in order, for rules that no window can express."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame


def ordered_fold(rows: DataFrame, key: str, order: str, values: list[str], out: str, step: Callable[..., tuple[Any, int]]) -> DataFrame:
    """(key, order, out) where ``step(state, *values)`` gives the next state and the row's number; the state is None at a key's first row.

    Rows are dealt by key, sorted, and streamed through Python, so neither a key's rows nor the keys are gathered.
    """
    kinds = {n: rows.schema[n].dataType.simpleString() for n in (key, order)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, last, begun = None, None, False
        for pdf in batches:
            numbers = []
            for k, *v in zip(pdf[key].tolist(), *[pdf[c].tolist() for c in values], strict=True):
                if not begun or k != last:
                    state, last, begun = None, k, True
                state, number = step(state, *v)
                numbers.append(number)
            yield pd.DataFrame({key: pdf[key], order: pdf[order], out: numbers})

    sorted_rows = rows.select(key, order, *values).repartition(key).sortWithinPartitions(key, order)
    return sorted_rows.mapInPandas(run, f"{key} {kinds[key]}, {order} {kinds[order]}, {out} long")
