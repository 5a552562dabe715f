"""Token counts of flat token files by a separator scan.

A token file is nothing but the ids of its documents, each followed by the end-of-document id; no index says where
documents begin. Files are read in blocks of fixed size, wherever that cuts. A vectorised search finds the separators
of each block on its own; a prefix scan over the blocks' summaries (how many separators, where the last one is) then
stitches the documents that run across blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelight.llm.common import stored
from cuelight.llm.packing import Tokenizer
from cuelight.operators.blocks import running

#: The id that ends a document in the files of this vocabulary, and bytes of a little-endian id.
END_ID = 50256
WIDTH = 2
BLOCK_TOKENS = 1 << 18
#: Blocks of a file that one window scans.
RUN = 4096.0


def written(
    docs: DataFrame,
    paths: tuple[str, str],
    end_id: int = END_ID,
    width: int = WIDTH,
    block_tokens: int = BLOCK_TOKENS,
) -> tuple[DataFrame, DataFrame]:
    """Tokenise whole texts into one token file for each input task, as a table of blocks in the shared folder.

    (file, block, payload), and for checks the order of documents: (file, ordinal, doc_id). A null text is an empty
    document.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok, kind = Tokenizer(*paths), np.dtype(f"<u{width}")
        name = f"part-{TaskContext.get().partitionId():05d}"
        held, n_held, block, ordinal = [], 0, 0, 0

        def blocks(last: bool) -> list[tuple]:
            nonlocal held, n_held, block
            out = []
            if n_held >= block_tokens or last and n_held:
                flat = np.concatenate(held)
                stop = len(flat) if last else len(flat) // block_tokens * block_tokens
                for at in range(0, stop, block_tokens):
                    out.append((name, block, flat[at : at + block_tokens].tobytes(), None, None))
                    block += 1
                held, n_held = [flat[stop:]], len(flat) - stop
            return out

        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                ids = np.array([*tok.plain_ids(text), end_id], dtype=kind)
                held.append(ids)
                n_held += len(ids)
                rows.append((name, None, None, ordinal, doc_id))
                ordinal += 1
                if n_held >= 8 * block_tokens:
                    rows += blocks(False)
            yield _frame(rows + blocks(False))
        yield _frame(blocks(True))

    schema = "file string, block long, payload binary, ordinal long, doc_id long"
    got = docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, schema)
    got = stored(got)
    return (
        got.where("block is not null").select("file", "block", "payload"),
        got.where("block is null").select("file", "ordinal", "doc_id"),
    )


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["file", "block", "payload", "ordinal", "doc_id"])
    return out.astype({"block": "Int64", "ordinal": "Int64", "doc_id": "Int64", "payload": object, "file": object})


def read_token_files(
    spark: SparkSession, path: str, width: int = WIDTH, block_tokens: int = BLOCK_TOKENS
) -> DataFrame:
    """(file, block, payload) of flat binary files that Spark can read; a file has less than 2 GB."""
    size = width * block_tokens

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                if len(content) % width:
                    raise ValueError(f"{name}: its length is no multiple of {width}")
                for block, at in enumerate(range(0, len(content), size)):
                    yield pd.DataFrame({"file": [name], "block": [block], "payload": [content[at : at + size]]})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(cut, "file string, block long, payload binary")


def token_counts(
    blocks: DataFrame, end_id: int = END_ID, width: int = WIDTH, block_tokens: int = BLOCK_TOKENS
) -> DataFrame:
    """(file, ordinal, start, n_tokens, terminated): each document's place in its file and its ids before the end id.

    blocks: (file, block, payload); all blocks of a file but its last hold block_tokens ids. Two separators in a row
    make an empty document. Ids after the last separator make one that isn't terminated. Rows with a null payload or
    an empty one are no block. A block is one row, so a file's size is no limit.
    """

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kind = np.dtype(f"<u{width}")
        for pdf in batches:
            found = [np.frombuffer(p, kind) for p in pdf["payload"]]
            yield pd.DataFrame(
                {
                    "file": pdf["file"],
                    "block": pdf["block"],
                    "n": [len(f) for f in found],
                    "ends": [np.flatnonzero(f == end_id).astype(np.int32) for f in found],
                }
            )

    scanned = stored(
        blocks.where("length(payload) > 0")
        .select("file", "block", "payload")
        .mapInPandas(search, "file string, block long, n int, ends array<int>")
    )
    # the scan runs over one small row a block, in runs of blocks, so even a single file is spread over tasks
    base = (F.col("block") * block_tokens).cast("long")
    summary = scanned.select(
        "file",
        "block",
        F.size("ends").cast("long").alias("__count"),
        F.when(F.size("ends") > 0, base + F.element_at("ends", -1)).alias("__last"),
    )
    earlier = {"__before": ("sum", F.col("__count")), "__previous": ("max", F.col("__last"))}
    forward = running(summary, "file", "block", ["block"], earlier, width=RUN)
    later = running(summary.select("file", "block"), "file", "block", ["block"], {"__after": ("count", F.lit(1))}, width=RUN, backwards=True)
    known = forward.select("file", "block", "__before", "__previous").join(later, ["file", "block"])
    # the separators' places join again by block, which no file makes uneven
    stitched = scanned.join(known, ["file", "block"]).select(
        "file",
        base.alias("base"),
        "n",
        "ends",
        F.coalesce("__before", F.lit(0)).alias("first_ordinal"),
        F.coalesce("__previous", F.lit(-1)).alias("previous"),
        (F.col("__after") == 0).alias("is_last"),
    )
    ended = stitched.select("file", "base", "ends", "first_ordinal", "previous", F.posexplode("ends").alias("i", "e"))
    ended = ended.select(
        "file",
        (F.col("first_ordinal") + F.col("i")).alias("ordinal"),
        F.when(F.col("i") == 0, F.col("previous") + 1)
        .otherwise(F.col("base") + F.expr("ends[greatest(i, 1) - 1]") + 1)
        .alias("start"),
        (F.col("base") + F.col("e")).alias("end"),
        F.lit(True).alias("terminated"),
    )
    tail = F.when(F.size("ends") > 0, F.col("base") + F.element_at("ends", -1) + 1).otherwise(F.col("previous") + 1)
    open_end = (
        stitched.where("is_last")
        .select(
            "file",
            (F.col("first_ordinal") + F.size("ends")).alias("ordinal"),
            tail.alias("start"),
            (F.col("base") + F.col("n")).alias("end"),
            F.lit(False).alias("terminated"),
        )
        .where(F.col("end") > F.col("start"))
    )
    return ended.unionByName(open_end).select(
        "file",
        F.col("ordinal").cast("long"),
        F.col("start").cast("long"),
        (F.col("end") - F.col("start")).cast("long").alias("n_tokens"),
        "terminated",
    )

