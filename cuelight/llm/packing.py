"""Pattern packing by non-negative least squares.

Patterns are short lists of lengths that fill a sequence exactly. How often each is used is the non-negative least
squares fit of all patterns to the histogram of lengths, rounded down; what is left is packed best fit decreasing, on
the histogram too. The driver therefore sees one count for each length, whatever the number of documents; documents
are then dealt to the places of the plan by their rank among those of equal length.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuelight.llm.common import stored

CAPACITY = 1024
END_ID = 2
PIECES = (
    "doc_id long, piece int, start long, length long, ids_crc32 long, __task int, __in_task long"
)


# ---- tokens ---------------------------------------------------------------------------------------------------------


class Tokenizer:
    """The ids of a byte-level BPE file, as the tokenizers library gives them without special tokens added.

    The same vocabulary as ranks runs several times faster, so texts go through that; a text that holds the string
    of a special token goes through the tokenizers file itself.
    """

    def __init__(self, json_path: str, ranks_path: str | None = None):
        from tokenizers import Tokenizer as Full

        self.full = Full.from_file(json_path)
        self.special = [t.content for t in self.full.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks_path:
            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding(
                "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
            )

    def ids(self, text: str | None) -> list[int]:
        text = text or ""
        if self.fast is None or any(s in text for s in self.special):
            return self.full.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)

    def plain_ids(self, text: str | None) -> list[int]:
        """The same, but the string of a special token is ordinary text, so no document holds a special id."""
        if self.fast is not None:
            return self.fast.encode_ordinary(text or "")
        self.full.encode_special_tokens = True
        try:
            return self.full.encode(text or "", add_special_tokens=False).ids
        finally:
            self.full.encode_special_tokens = False


def tokenizer_paths(name: str = "byte_bpe_50k") -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(f"{name}.json"), public_tokenizers.path(f"{name}.tiktoken")


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones, but for the first, which may be shorter."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    starts = [0, *range(first, n, capacity)]
    return [(a, b - a) for a, b in zip(starts, [*starts[1:], n])]


def pieces(docs: DataFrame, paths: tuple[str, str], capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Tokenise whole texts and cut the longer ones. Each piece knows its rank among its task's equal lengths."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = Tokenizer(*paths)
        task, seen = TaskContext.get().partitionId(), defaultdict(int)
        for pdf in batches:
            out = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                ids = np.array([*tok.ids(text), end_id], dtype="<u4")
                for k, (start, n) in enumerate(cut(len(ids), capacity)):
                    out.append((doc_id, k, start, n, zlib.crc32(ids[start : start + n]), task, seen[n]))
                    seen[n] += 1
            yield pd.DataFrame(
                out, columns=["doc_id", "piece", "start", "length", "ids_crc32", "__task", "__in_task"]
            ).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, PIECES)


# ---- the plan, on the histogram alone ------------------------------------------------------------------------------


def patterns(capacity: int, step: int | None = None) -> list[tuple[int, ...]]:
    """Patterns of two lengths, all of them, and of three of which one is a multiple of step; each fills a sequence."""
    step = step or max(1, capacity // 32)
    found = {(a, capacity - a) for a in range(1, capacity // 2 + 1)}
    for a in range(step, capacity // 2, step):
        found |= {tuple(sorted((a, b, capacity - a - b))) for b in range(1, capacity - a)}
    return sorted(tuple(sorted(p, reverse=True)) for p in found)


def fitted(histogram: np.ndarray, columns: list[tuple[int, ...]], sweeps: int = 25) -> np.ndarray:
    """x >= 0 that makes |A x - histogram| least, by coordinate descent; column p of A counts the lengths of pattern p."""
    left = histogram.astype(float).tolist()
    x = [0.0] * len(columns)
    forms = []
    for p in columns:
        counts = defaultdict(int)
        for n in p:
            counts[n] += 1
        forms.append((list(counts.items()), sum(c * c for c in counts.values())))
    for _ in range(sweeps):
        moved = 0.0
        for k, (terms, norm) in enumerate(forms):
            d = max(sum(left[n] * c for n, c in terms) / norm, -x[k])
            if d:
                x[k] += d
                for n, c in terms:
                    left[n] -= d * c
                moved = max(moved, abs(d))
        if moved < 0.05:
            break
    return np.array(x)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, how many sequences are filled by it), for exactly the lengths of the histogram."""
    count = np.zeros(capacity + 1, dtype=np.int64)
    for n, k in histogram.items():
        count[n] = k
    out: list[tuple[tuple[int, ...], int]] = []
    if count[capacity]:
        out.append(((capacity,), int(count[capacity])))
        count[capacity] = 0
    columns = [p for p in patterns(capacity) if all(count[n] for n in p)]
    x = fitted(count, columns)
    for k in np.argsort(-x, kind="stable"):
        times = int(x[k])
        if times < 1:
            break
        need = defaultdict(int)
        for n in columns[k]:
            need[n] += 1
        times = min([times, *(int(count[n]) // c for n, c in need.items())])
        if times:
            out.append((columns[k], times))
            for n, c in need.items():
                count[n] -= times * c
    return out + residual(count, capacity)


def residual(count: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit decreasing for counts: open sequences with equal contents are kept as one entry with a number."""
    by_room: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)

    def put(room: int, held: tuple[int, ...], times: int) -> None:
        if times:
            by_room[room][held] = by_room[room].get(held, 0) + times

    for n in range(capacity, 0, -1):
        c = int(count[n])
        while c:
            room = next((r for r in range(n, capacity) if by_room.get(r)), capacity)
            per = room // n
            if room == capacity:
                full, rest = divmod(c, per)
                put(room - per * n, (n,) * per, full)
                if rest:
                    put(room - rest * n, (n,) * rest, 1)
                break
            held = min(by_room[room])
            times = by_room[room].pop(held)
            used = min(times, c // per)
            put(room - per * n, held + (n,) * per, used)
            c -= used * per
            if used < times:
                rest = min(c, per)
                put(room - rest * n, held + (n,) * rest, 1 if rest else 0)
                put(room, held, times - used - (1 if rest else 0))
                c -= rest
    return sorted((held, times) for own in by_room.values() for held, times in own.items())


def places(the_plan: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[list[int], list[tuple[int, int, list[int]]]]]:
    """For each length: the last ranks of its runs, and each run's first rank, first sequence and offsets."""
    out: dict[int, tuple[list[int], list]] = defaultdict(lambda: ([], []))
    taken: dict[int, int] = defaultdict(int)
    sequence = 0
    for held, times in the_plan:
        offsets = defaultdict(list)
        at = 0
        for n in held:
            offsets[n].append(at)
            at += n
        for n, own in offsets.items():
            ends, runs = out[n]
            runs.append((taken[n], sequence, own))
            taken[n] += times * len(own)
            ends.append(taken[n] - 1)
        sequence += times
    return dict(out)


# ---- the operator ----------------------------------------------------------------------------------------------------


def packed(
    docs: DataFrame, paths: tuple[str, str] | None = None, capacity: int = CAPACITY, end_id: int = END_ID
) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the end id alone. Repeated rows are packed as often as they come; a null doc_id stays
    null. Columns other than doc_id and text aren't read. An empty table gives an empty table. Pieces of equal
    length are interchangeable; their order is that of the input tasks. The pieces (not the ids) are written to the
    shared folder once, then counted by task and length; the plan's size is bounded by the number of patterns.
    """
    spark = docs.sparkSession
    cutup = stored(pieces(docs, paths or tokenizer_paths(), capacity, end_id))
    by_task = cutup.groupBy("__task", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    at = places(plan(histogram, capacity))
    before = Window.partitionBy("length").orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_task.select("__task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    shared = spark.sparkContext.broadcast(at)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = shared.value
        for pdf in batches:
            sequence, offset = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
            for i, (n, r) in enumerate(zip(pdf["length"].tolist(), pdf["__rank"].tolist())):
                ends, runs = at[n]
                first, base, own = runs[bisect_left(ends, r)]
                sequence[i], k = base + (r - first) // len(own), (r - first) % len(own)
                offset[i] = own[k]
            yield pdf.drop(columns="__rank").assign(sequence_id=sequence, offset=offset).astype({"doc_id": "Int64"})

    return (
        cutup.join(offsets, ["__task", "length"])
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("__before") + F.col("__in_task")).alias("__rank"))
        .mapInPandas(
            deal, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
        )
    )
