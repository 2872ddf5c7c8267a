"""Arrow batches in tasks: added columns, and words of a text column as 64-bit hashes.

Words are runs of letters and digits; ASCII and Latin-1 letters are folded to lower case, every other character beyond ASCII
counts as a letter. Texts are worked on in chunks of a quarter of a megabyte, so a task's memory does not depend on its rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

CHUNK = 1 << 18
BATCH_ROWS = 500
FOLD = np.array([b if b >= 128 else ord(chr(b).lower()) if chr(b).isalnum() else 0 for b in range(256)], np.uint8)
POWERS = np.random.default_rng(2024).integers(1, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
MIX = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def add_columns(df: DataFrame, column: str, compute: Callable[[pa.Array], list], fields: str) -> DataFrame:
    """``df`` with the columns ``fields`` that ``compute`` makes of an Arrow array of ``column``.

    Columns of the input that have one of the new names are replaced; ``column`` itself may not have one.
    """
    new = StructType.fromDDL(fields)
    names = {f.name.lower() for f in new}
    if column.lower() in names:
        raise ValueError(f"the input column {column} has the name of a result column")
    df = df.select(*[f"`{c}`" for c in df.columns if c.lower() not in names])
    schema = StructType(df.schema.fields + new.fields)
    place = [c.lower() for c in df.columns].index(column.lower())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            more = compute(batch.column(place))
            yield pa.RecordBatch.from_arrays(batch.columns + more, names=batch.schema.names + [f.name for f in new])

    return small_batches(df).mapInArrow(run, schema)


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session that hands whole texts to Python BATCH_ROWS at a time, unless it has a number of its own."""
    name, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if conf.get(name) == "10000":  # Spark's default, meant for narrow rows
        conf.set(name, str(BATCH_ROWS))
    return df


def keep_rows(df: DataFrame, column: str, judge: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """The rows of ``df`` for which ``judge`` of an Arrow array of ``column`` is true, with all columns as they are."""
    place = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(judge(batch.column(place)), pa.bool_()))

    return small_batches(df).mapInArrow(run, df.schema)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a text column; null reads as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return at, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def chunks(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``limit`` bytes each, one row at least."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = min(max(int(np.searchsorted(offsets, offsets[row] + limit)), row + 1), n)
        yield row, end
        row = end


def mixed(h: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of ``h``."""
    h = (h ^ (h >> np.uint64(30))) * MIX[0]
    h = (h ^ (h >> np.uint64(27))) * MIX[1]
    return h ^ (h >> np.uint64(31))


def hashed_words(data: np.ndarray, starts: np.ndarray, first_bytes: int = 0) -> tuple[np.ndarray, np.ndarray] | tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of some rows, and where each row's words start; with ``first_bytes`` also hashes of the words' first bytes.

    ``starts`` holds the row starts in ``data`` and its end. Words longer than 256 bytes hash alike if they hold the same
    bytes at the same places modulo 256.
    """
    norm = FOLD[data]
    after = np.flatnonzero(data[:-1] == 0xC3) + 1  # capitals of Latin-1 in UTF-8
    capital = after[(data[after] >= 0x80) & (data[after] <= 0x9E) & (data[after] != 0x97)]
    norm[capital] += 0x20
    letter = norm != 0
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    edges = starts[:-1][starts[:-1] < len(data)]
    first[edges] = letter[edges]
    at = np.flatnonzero(first)
    if not len(at):
        none = np.zeros(0, np.uint64), np.zeros(len(starts), np.int64)
        return (*none, none[0]) if first_bytes else none
    place = np.arange(len(data)) - at[np.cumsum(first) - 1]
    value = POWERS[place & 255] * norm
    out = mixed(np.add.reduceat(value, at)), np.searchsorted(at, starts)
    return (*out, mixed(np.add.reduceat(np.where(place < first_bytes, value, np.uint64(0)), at))) if first_bytes else out


def words_of(column: pa.Array, first_bytes: int = 0) -> Iterator[tuple]:
    """(first row, word hashes, word offsets per row) for chunks of a text column; see :func:`hashed_words`."""
    offsets, data = utf8(column)
    for a, b in chunks(offsets):
        yield a, *hashed_words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], first_bytes)
