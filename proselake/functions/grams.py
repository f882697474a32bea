"""Counts of runs of characters or words within a row: one Arrow pass, no row and no shuffle for each run."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_PRIME = np.uint64(0x9E3779B97F4A7C15)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def numbered(tokens: list[str]) -> np.ndarray:
    table: dict[str, int] = {}
    return np.array([table.setdefault(t, len(table)) for t in tokens], np.uint64)


def run_keys(ids: np.ndarray, n: int) -> np.ndarray:
    """A number for each run of n ids, equal for equal runs: packed while three ids of 21 bits fit, hashed beyond."""
    m = len(ids) - n + 1
    out = ids[:m].copy()
    with np.errstate(over="ignore"):
        for j in range(1, n):
            out = (out << np.uint64(21) | ids[j : j + m]) if n <= 3 else (out * _PRIME + ids[j : j + m]) ^ (out >> np.uint64(29))
    return out


def run_counts(ids: np.ndarray, n: int) -> np.ndarray:
    """How often each different run of n ids stands there; empty where there are fewer ids."""
    return np.unique(run_keys(ids, n), return_counts=True)[1] if len(ids) >= n else np.zeros(0, np.int64)


def entropy(counts: np.ndarray) -> float:
    """Shannon entropy in bits."""
    total = counts.sum()
    return float(np.log2(total) - (counts * np.log2(counts)).sum() / total)


def per_row(df: DataFrame, of: Callable[[object], list[tuple]], columns: str) -> DataFrame:
    """From (doc_id, what): doc_id + the columns of each tuple that `of` gives for a row's content."""
    names = [c.split()[0] for c in columns.split(",")]
    types = [{"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}[c.split()[1]] for c in columns.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, rows = [], []
            for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for r in of(x):
                    ids.append(i), rows.append(r)
            cols = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(c, t) for c, t in zip(cols, types))], ["doc_id", *names])

    return df.mapInArrow(run, f"doc_id bigint, {columns}")
