"""What several corpus operators share: shared-folder tables, bounded tree sums, components, word hashing."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelight.sources.storage import settled

SHINGLE = 5
#: Up to so many small rows, 16 bytes each, are broadcast.
SMALL = 1_000_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def stored(df: DataFrame) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it again.

    The lineage ends there, so a lost executor costs a read, not a second run of what came before.
    The folder goes when the application ends.
    """
    return settled(df)


def packed(counts: np.ndarray) -> bytes:
    """Counts as compressed 64-bit numbers; most of a task's counters are small."""
    return zlib.compress(counts.astype(np.int64).tobytes(), 1)


def summed(parts: DataFrame, tasks: int, fan_in: int = 64) -> np.ndarray:
    """The sum of vectors that tasks have counted.

    parts: (chunk int, task int, counts binary as packed() gives). A group of at most fan_in rows is added at a
    time, so no task holds more than fan_in chunks, whatever the number of input tasks. What reaches the
    driver is one vector of the size that the caller has fixed.
    """

    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.int64(0)
        for part in pdf["counts"]:
            total = total + np.frombuffer(zlib.decompress(part), np.int64)
        return pd.DataFrame({"chunk": [key[0]], "task": [key[1]], "counts": [packed(total)]})

    while True:
        parts = (
            parts.withColumn("task", F.expr(f"cast(task div {fan_in} as int)"))
            .groupBy("chunk", "task")
            .applyInPandas(add, "chunk int, task int, counts binary")
        )
        tasks = -(-tasks // fan_in)
        if tasks <= 1:
            break
    rows = sorted(parts.collect(), key=lambda r: r["chunk"])
    return np.concatenate([np.frombuffer(zlib.decompress(r["counts"]), np.int64) for r in rows]) if rows else np.zeros(0, np.int64)


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """Connected components of (a, b) longs: (id, component), the smallest id that links reach.

    Large-star and small-star turns until nothing moves. Every turn is a table in the shared folder, so
    nothing of the graph is gathered on the driver but one count. A hub's links are aggregated
    (partial min first), never listed.
    """

    def turn(e: DataFrame, edges: int) -> DataFrame:
        # few links need few tasks, and their table of minima fits every executor; many are shuffled
        few = edges <= SMALL
        at_most = lambda df: df.coalesce(4 + edges // 50_000) if few else df
        told = lambda df: F.broadcast(df) if few else df
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = at_most(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = (
            both.where("b > a")
            .join(told(low), "a")
            .where("b <> m")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
        )
        # the smallest neighbour itself is linked from the node
        own = low.where("a <> m").select("a", F.col("m").alias("b"))
        e = at_most(large.unionByName(own).distinct())
        low = at_most(e.groupBy("a").agg(F.min("b").alias("m")))
        small = e.join(told(low), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return at_most(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct())

    def digest(e: DataFrame) -> tuple:
        r = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        return r["n"], r["s"]

    now = stored(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    )
    before = digest(now)
    for _ in range(rounds):
        if not before[0]:
            break
        now = stored(turn(now, before[0]))
        after = digest(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components still moved after {rounds} turns")
    stars = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("id"), "component").distinct())


class WordHashes(dict):
    """word -> 64-bit hash, of texts or of their UTF-8 bytes; forgets all once it holds too many words."""

    LIMIT = 250_000

    def __missing__(self, word: str | bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_MIX = np.uint64(0x9E3779B97F4A7C15)
_TURN = np.uint64(31)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of uint64."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(hashes: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """One uint64 for each run of k words in order; for fewer words, one for them all; none for none."""
    n = len(hashes)
    if n == 0:
        return hashes
    if n < k:
        k = n
    out = hashes[: n - k + 1].copy()
    for i in range(1, k):
        out *= _MIX
        out ^= out >> _TURN
        out += hashes[i : n - k + 1 + i]
    return mixed(out + np.uint64(k))


def parts_of(batches: Iterator[pd.DataFrame], rows: int = 512) -> Iterator[pd.DataFrame]:
    """Batches in smaller parts, for work whose results take several times the room of its texts."""
    for pdf in batches:
        for lead in range(0, len(pdf), rows):
            yield pdf.iloc[lead : lead + rows]


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PLACES = 64
_CUT = 1 << 20


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """A random number for each byte, equal for both cases of an ASCII letter and 0 for white space, and an independent
    random number for each place in a word, so that words of up to _PLACES bytes are hashed multilinearly."""
    rng = np.random.default_rng(20)
    of = rng.integers(1, 1 << 63, 256, dtype=np.uint64)
    of[65:91] = of[97:123]
    of[_SPACE] = 0
    return of, rng.integers(0, 1 << 63, _PLACES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_BYTE, _PLACE = _tables()
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def word_hashes(text: str | None) -> np.ndarray:
    """A uint64 for each word of the text in order: words are runs of anything but ASCII white space, A to Z in lower
    case. The UTF-8 bytes are hashed together as arrays, in pieces that end at white space."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    if len(data) <= _CUT:
        return _hashed(data)
    out, begin = [], 0
    while begin < len(data):
        rest = np.flatnonzero(_SPACE[data[begin + _CUT : begin + 2 * _CUT]])
        end = begin + _CUT + int(rest[0]) if len(rest) else len(data)
        out.append(_hashed(data[begin:end]))
        begin = end
    return np.concatenate(out)


def _hashed(data: np.ndarray) -> np.ndarray:
    space = _SPACE[data]
    starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    if not len(starts):
        return np.zeros(0, np.uint64)
    data, space, starts = data[starts[0] :], space[starts[0] :], starts - starts[0]
    gaps = np.diff(starts, append=len(data))
    place = np.arange(len(data)) - np.repeat(starts, gaps)
    sums = np.add.reduceat(_BYTE[data] * _PLACE[np.minimum(place, _PLACES - 1)], starts)
    lengths = np.add.reduceat((~space).astype(np.uint64), starts)
    out = mixed(sums + lengths * _MIX)
    for k in np.flatnonzero(lengths > _PLACES).tolist():  # few words are so long; their bytes are hashed as they are
        word = data[starts[k] : starts[k] + int(lengths[k])].tobytes().translate(_LOWER)
        out[k] = xxhash.xxh3_64_intdigest(word, seed=_PLACES)
    return out


def mapped(df: DataFrame, work: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """mapInPandas for work on one batch at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield work(pdf)

    return df.mapInPandas(run, schema)
