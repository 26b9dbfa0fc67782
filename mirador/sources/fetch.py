"""A hook for live connectors, off by default: a query reads lookup tables, never the network.

``fetched`` runs a caller's function over keys in batches, with a pause per task between calls. Give the result to the
operators of ``enrich`` as a lookup table.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def fetched(keys: DataFrame, column: str, call: Callable[[str], str | None], pause: float = 1.0) -> DataFrame:
    """(column, body, error): ``call`` of each distinct key; an exception becomes its message."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k in b[column]:
                try:
                    rows.append((k, call(k), None))
                except Exception as e:  # noqa: BLE001 - one key must not stop the others
                    rows.append((k, None, str(e)[:200]))
                time.sleep(pause)
            yield pd.DataFrame(rows, columns=[column, "body", "error"])

    return keys.select(column).where(f"{column} is not null").distinct().mapInPandas(run, f"{column} string, body string, error string")
