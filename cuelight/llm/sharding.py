"""Uniform sharding by a communication matrix of hypergeometric counts.

How many rows each input partition sends to each cell is drawn exactly, so that every cell gets the number of rows
fixed for it and every permutation of all rows is equally likely. Rows are permuted within their partition, dealt
out by those counts and permuted again within their cell. A shard is a run of cells, so no task holds a whole shard.

The matrix of counts is never held whole. Partitions are the leaves of a tree; each node draws, from a seed of its own,
how many rows of each cell come from its left half, so a task finds the row of its partition on the way down from the
root, and every task that passes a node draws the same there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuelight.llm.common import stored

ROWS_PER_CELL = 8192
MAX_PARTITIONS = 4096
MAX_CELLS = 16_384
#: numpy draws from populations below this; beyond it, drawn() does.
NUMPY_LIMIT = 10**9


def cell_sizes(rows: int, shards: int, rows_per_cell: int, max_cells: int) -> list[list[int]]:
    """For each shard the sizes of its cells. Shards differ by one row at most, and so do a shard's cells."""
    per_shard = [rows // shards + (s < rows % shards) for s in range(shards)]
    wanted = max(1, -(-(rows // shards + 1) // rows_per_cell))
    cells = max(1, min(wanted, max_cells // shards))
    return [[n // cells + (c < n % cells) for c in range(cells)] for n in per_shard]


def drawn(rng: np.random.Generator, good: int, bad: int, n: int, limit: int = NUMPY_LIMIT) -> int:
    """A hypergeometric number: how many of n draws out of good and bad ones are good.

    Beyond numpy's limit by inversion: chances around the likeliest number follow from one another by exact ratios, and
    what lies further than 40 deviations off has less chance than one in 2^1000.
    """
    if good + bad < limit:
        return int(rng.hypergeometric(good, bad, n)) if good and n else 0
    total, low, high = good + bad, max(0, n - bad), min(good, n)
    if low == high:
        return low
    top = min(high, max(low, (n + 1) * (good + 1) // (total + 2)))
    spread = math.sqrt(n / total * good * (bad / total) * ((total - n) / max(1, total - 1)))
    width = int(40 * spread) + 40
    up = np.arange(top, min(high, top + width), dtype=np.float64)
    above = np.cumsum(np.log(good - up) + np.log(n - up) - np.log(up + 1) - np.log(bad - n + up + 1))
    down = np.arange(top, max(low, top - width), -1, dtype=np.float64)
    below = np.cumsum(np.log(down) + np.log(bad - n + down) - np.log(good - down + 1) - np.log(n - down + 1))
    chance = np.exp(np.concatenate([below[::-1], [0.0], above]))
    sums = np.cumsum(chance)
    return top - len(below) + int(np.searchsorted(sums, rng.random() * sums[-1], side="right"))


def dealt(seed: int, room: np.ndarray, n: int, limit: int = NUMPY_LIMIT) -> np.ndarray:
    """How many of n rows go to each cell with so much room, where every choice of places is equally likely."""
    rng = np.random.default_rng(seed)
    total = int(room.sum())
    if total < limit:
        return rng.multivariate_hypergeometric(room, n, method="marginals")
    out = np.zeros(len(room), np.int64)
    for j, own in enumerate(room.tolist()):  # one margin at a time
        if not n:
            break
        out[j] = drawn(rng, own, total - own, n, limit)
        total -= own
        n -= int(out[j])
    return out


def matrix_row(sent: list[int], wanted: list[int], seed: int, i: int, limit: int = NUMPY_LIMIT) -> np.ndarray:
    """How many rows partition i sends to each cell: its row of a matrix with margins sent and wanted."""
    before = [0, *np.cumsum(sent, dtype=object)]
    room = np.array(wanted, dtype=np.int64)
    low, high = 0, len(sent)
    while high - low > 1:
        mid = (low + high) // 2
        left = dealt([seed, low, high], room, int(before[mid] - before[low]), limit)
        room, low, high = (left, low, mid) if i < mid else (room - left, mid, high)
    return room


def communication_matrix(sent: list[int], wanted: list[int], seed: int, limit: int = NUMPY_LIMIT) -> np.ndarray:
    """Counts[i, j] of rows that go from partition i to cell j in a uniform permutation of all rows."""
    return np.array([matrix_row(sent, wanted, seed, i, limit) for i in range(len(sent))])


def uniform_shards(
    rows: DataFrame,
    shards: int,
    seed: int = 17,
    rows_per_cell: int = ROWS_PER_CELL,
    max_partitions: int = MAX_PARTITIONS,
    max_cells: int = MAX_CELLS,
) -> DataFrame:
    """Every row with ``shard`` (0 to shards-1) and ``slot`` (gapless from 0 within the shard), uniformly at random.

    All rows and columns stay, repeated rows and nulls too: a row is known by its place, not by its values.
    Input columns named shard or slot are replaced; names that start with ``__`` are the operator's own.
    An empty table gives an empty table. The rows are written once to the shared folder, so that the draw and the
    exchange see the same partitions even if executors are lost. The driver holds at most max_partitions and max_cells
    numbers; each partition's row of the matrix is drawn in a task.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    spark = rows.sparkSession
    kept = [c for c in rows.columns if c.lower() not in ("shard", "slot")]
    placed = stored(
        rows.select(*[F.col(f"`{c}`") for c in kept])
        .withColumn("__place", F.monotonically_increasing_id())
        .withColumn("__from", F.expr(f"cast(shiftright(__place, 33) % {int(max_partitions)} as int)"))
    )
    counts = {r["__from"]: r["n"] for r in placed.groupBy("__from").agg(F.count("*").alias("n")).collect()}
    froms = sorted(counts)
    sizes = cell_sizes(sum(counts.values()), shards, rows_per_cell, max_cells)
    flat = [n for own in sizes for n in own]
    shard_of = [s for s, own in enumerate(sizes) for _ in own]
    first_slot = [sum(own[:c]) for own in sizes for c in range(len(own))]
    sent = [counts[f] for f in froms]

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i, f in zip(pdf["i"].tolist(), pdf["f"].tolist()):
                row = matrix_row(sent, flat, seed, i)
                some = np.flatnonzero(row)
                highs = np.cumsum(row[some])
                yield pd.DataFrame({"__from": [f], "__highs": [highs.tolist()], "__cells": [some.tolist()]})

    numbered = spark.createDataFrame([(i, int(f)) for i, f in enumerate(froms)], "i int, f int")
    tasks = max(1, min(len(froms), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    deals = numbered.repartition(tasks).mapInPandas(draw, "__from int, __highs array<long>, __cells array<int>")
    cells = spark.createDataFrame(
        [(j, shard_of[j], first_slot[j]) for j in range(len(flat))], "__cell int, shard int, __first long"
    )
    own_rank = Window.partitionBy("__from").orderBy(F.xxhash64(F.lit(seed), "__place"), "__place")
    cell_rank = Window.partitionBy("__cell").orderBy(F.xxhash64(F.lit(seed + 1), "__place"), "__place")
    sent_rows = (
        placed.withColumn("__rank", F.row_number().over(own_rank))
        .join(deals, "__from")
        .withColumn("__cell", F.expr("get(__cells, size(filter(__highs, h -> h < __rank)))"))
        .drop("__highs", "__cells", "__rank")
    )
    return (
        sent_rows.withColumn("__rank", F.row_number().over(cell_rank))
        .join(cells, "__cell")
        .withColumn("slot", F.col("__first") + F.col("__rank") - 1)
        .select(*[F.col(f"`{c}`") for c in kept], "shard", F.col("slot").cast("long"))
    )


def document_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32): UTF-8 bytes plus one, and the text's checksum; a null text counts as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
