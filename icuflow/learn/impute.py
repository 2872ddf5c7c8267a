"""Chained-regression imputation from one pass over the table.

A regression needs only sums of products, and a filled cell is a fixed linear form of the row's other cells, the same one for all rows with
the same gaps. So all rows with one pattern of gaps may be replaced by the triangle of their QR decomposition, at most one row more
than there are columns, with the same sums of products before and after every step. Tasks shrink their rows by pattern, Spark brings the
triangles of a pattern together, and the whole chain of regressions runs on what is left.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from icuflow.sources.tables import stage


class Step(NamedTuple):
    """Guess for one column from all others: intercept plus weights in column order (own weight 0)."""

    column: int
    intercept: float
    weights: list[float]


RIDGE = 1e-6  # share of each column's variance added to the normal equations
HELD_CELLS = 1 << 23  # cells of shrunk rows that the driver may hold; beyond, each regression is a job over them
TASK_CELLS = 1 << 22


def _applied(x: np.ndarray, gap: np.ndarray, steps: Sequence[Step]) -> np.ndarray:
    """``x`` after the steps, one after the other, each on the rows with a gap in its column.

    A chain of projections would inline every step into the next and grow without bound; on an
    Arrow batch each step is one matrix product.
    """
    for step in steps:
        rows = gap[:, step.column]
        x[rows, step.column] = step.intercept + x[rows] @ np.array(step.weights)
    return x


def _fill(steps: Sequence[Step], columns: Sequence[str]):
    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            gap = batch[[f"_gap_{c}" for c in columns]].to_numpy(dtype=bool)
            batch[list(columns)] = _applied(batch[list(columns)].to_numpy(dtype=float, copy=True), gap, steps)
            yield batch
    return fill


def triangle(z: np.ndarray) -> np.ndarray:
    """At most as many rows as columns, with the same sums of products."""
    return np.linalg.qr(z, mode="r") if len(z) > z.shape[1] else z


def shrunk(rows: DataFrame, columns: Sequence[str], centre: np.ndarray) -> DataFrame:
    """(pattern, z): per pattern of gaps the triangle of its rows (1, x - centre); gaps are 0, so ``centre`` holds the starting values.

    A task holds up to ``TASK_CELLS`` cells of patterns before it hands them on; the triangles of a pattern meet in one task, one after the other.
    """
    size = len(columns) + 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[np.ndarray]] = {}
        n = 0
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
            gap = np.isnan(x)
            z = np.column_stack([np.ones(len(x)), np.where(gap, 0.0, x - centre)])
            keys = np.packbits(gap, axis=1)
            names, of = np.unique(keys, axis=0, return_inverse=True)
            for i, name in enumerate(names):
                held.setdefault(name.tobytes(), []).append(z[of.ravel() == i])
            n += len(x)
            if n * size > TASK_CELLS:
                held = {k: [triangle(np.concatenate(v))] for k, v in held.items()}
                n = sum(len(v[0]) for v in held.values())
                if n * size > TASK_CELLS // 2:
                    yield packed(held)
                    held, n = {}, 0
        yield packed({k: [triangle(np.concatenate(v))] for k, v in held.items()})

    def packed(held: dict[bytes, list[np.ndarray]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array([v[0].tobytes() for v in held.values()], pa.binary())], names=["pattern", "z"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, z = None, None
        for batch in batches:
            for pattern, more in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = np.frombuffer(more).reshape(-1, size)
                if pattern == now:
                    z = triangle(np.concatenate([z, part]))
                    continue
                if now is not None:
                    yield packed({now: [z]})
                now, z = pattern, part
        if now is not None:
            yield packed({now: [z]})

    ddl = "pattern binary, z binary"
    known = rows.select(F.array(*[F.col(c).cast("double") for c in columns]))
    return known.mapInArrow(cut, ddl).repartition("pattern").sortWithinPartitions("pattern").mapInArrow(merged, ddl)


def unpacked(patterns: list[bytes], z: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shrunk rows and their gaps."""
    parts = [np.frombuffer(v).reshape(-1, size) for v in z]
    gaps = [np.repeat(np.unpackbits(np.frombuffer(p, np.uint8))[None, : size - 1].astype(bool), len(v), 0) for p, v in zip(patterns, parts)]
    return np.concatenate([np.zeros((0, size)), *parts]), np.concatenate([np.zeros((0, size - 1), bool), *gaps])


def after(z: np.ndarray, gap: np.ndarray, solved: Sequence[tuple[int, np.ndarray]]) -> np.ndarray:
    """Shrunk rows after some steps; a step's weights are in the order of the shrunk row, its own 0."""
    for column, weights in solved:
        rows = gap[:, column]
        z[rows, column + 1] = z[rows] @ weights
    return z


def solve(total: np.ndarray, column: int) -> np.ndarray:
    """Ridge regression of a column on all others from the sums of products; the constant isn't held back."""
    others = np.delete(np.arange(len(total)), column + 1)
    normal = total[np.ix_(others, others)]
    spread = np.diag(normal) - normal[0] ** 2 / normal[0, 0]
    solved = np.linalg.lstsq(normal + RIDGE * np.diag(np.maximum(spread, 0.0)), total[others, column + 1], rcond=None)[0]
    return np.insert(solved, column + 1, 0.0)


class Shrunk:
    """The shrunk rows on the driver, brought up to date after every step."""

    def __init__(self, table: pa.Table, size: int):
        self.z, self.gap = unpacked(table["pattern"].to_pylist(), table["z"].to_pylist(), size)
        self.z = self.z.copy()

    def products(self, column: int) -> np.ndarray:
        known = self.z[~self.gap[:, column]]
        return known.T @ known

    def apply(self, column: int, weights: np.ndarray) -> None:
        after(self.z, self.gap, [(column, weights)])


class Spread:
    """The shrunk rows in Spark: a regression is one job over them."""

    def __init__(self, rows: DataFrame, size: int):
        self.rows, self.size, self.solved = rows, size, []

    def products(self, column: int) -> np.ndarray:
        size, solved = self.size, list(self.solved)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((size, size))
            for batch in batches:
                z, gap = unpacked(batch.column(0).to_pylist(), batch.column(1).to_pylist(), size)
                known = after(z, gap, solved)[~gap[:, column]]
                total += known.T @ known
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size * size, dtype=np.int32)), pa.array(total.ravel())], names=["cell", "value"])

        cells = self.rows.mapInArrow(add, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
        total = np.zeros(size * size)
        total[cells["cell"].to_numpy()] = cells["value"].to_numpy()
        return total.reshape(size, size)

    def apply(self, column: int, weights: np.ndarray) -> None:
        self.solved.append((column, weights))


class Imputer(NamedTuple):
    """Start means and the fitted regressions in the order they were applied."""

    columns: list[str]
    means: dict[str, float]
    steps: list[Step]

    def start(self, df: DataFrame) -> DataFrame:
        gaps = {f"_gap_{c}": F.col(c).isNull() for c in self.columns}
        return df.withColumns(gaps).withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(self.means[c])) for c in self.columns})

    def apply(self, df: DataFrame) -> DataFrame:
        """The fitted steps on any table, in one pass."""
        rows = self.start(df)
        filled = rows.mapInPandas(_fill(self.steps, self.columns), rows.schema) if self.steps else rows
        return filled.drop(*[f"_gap_{c}" for c in self.columns])


def fit_imputer(train: DataFrame, columns: Sequence[str], rounds: int = 3, held_cells: int = HELD_CELLS) -> tuple[Imputer, DataFrame]:
    """Mean start, then ``rounds`` times a linear regression of each incomplete column on all others, fewest gaps first.

    One pass gives the means and counts, one shrinks the rows, and one fills the table with all steps, however many columns and rounds there are.
    Only if gaps make so many patterns that the shrunk rows have more than ``held_cells`` cells, each regression is a job
    over the shrunk rows. A column without any value starts at, and keeps, zero; NaN counts as a value for neither.
    """
    columns = list(columns)
    plain = train.withColumns({c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in columns})
    rows = stage(plain, "impute")
    stats = rows.agg(
        *[F.avg(c).alias(f"m_{c}") for c in columns], *[F.count_if(F.col(c).isNull()).alias(f"g_{c}") for c in columns],
        F.count(F.lit(1)).alias("n"),
    ).first()
    means = {c: float(stats[f"m_{c}"]) if stats[f"m_{c}"] is not None else 0.0 for c in columns}
    incomplete = sorted((c for c in columns if 0 < stats[f"g_{c}"] < stats["n"]), key=lambda c: (stats[f"g_{c}"], c))
    imputer = Imputer(columns, means, [])
    centre, size = np.array([means[c] for c in columns]), len(columns) + 1
    if incomplete and rounds:
        held = stage(shrunk(rows, columns, centre), "shrunk")
        cells = held.agg(F.sum(F.octet_length("z")) / 8).first()[0]
        table = Shrunk(held.toArrow(), size) if cells <= held_cells else Spread(held, size)
        for _ in range(rounds):
            for column in incomplete:
                at = columns.index(column)
                weights = solve(table.products(at), at)
                table.apply(at, weights)
                imputer.steps.append(Step(at, float(centre[at] + weights[0] - weights[1:] @ centre), weights[1:].tolist()))
    return imputer, stage(imputer.apply(rows), "imputed")
