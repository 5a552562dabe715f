"""Benchmark decontamination by spaced seeds, in DataFrame functions alone.

A mask says which positions of a short window of words count. The counted words of every window of every benchmark
item and of every document are hashed, mask by mask, and joined; a substituted word at an ignored position doesn't
hide a hit. Around each hit the item is laid along the document at that offset and compared word by word.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Masks in each of which five words count. Wherever an item of eight words or more equals a document in 80 % of a window
#: of 13 words (or of the whole item, if shorter), at least one of them lies on equal words; a test goes through all
#: patterns of substitution.
MASKS = ("111011", "1101011", "1110011")
#: Items with fewer words than this have masks of their own.
SHORT = 8


@dataclass(frozen=True)
class Overlap:
    """window: the words in which an overlap is judged (the whole item, if that is shorter); similarity: the least share
    of equal words in the best window; shortest: the least words of an item that counts as a passage; broadcast_mb: the
    most of benchmark seeds and their items' words that is sent to every executor."""

    window: int = 13
    similarity: float = 0.8
    shortest: int = 4
    broadcast_mb: int = 64
    masks: tuple[str, ...] = MASKS

    def short_masks(self, n: int) -> tuple[str, ...]:
        """Masks that find an item of n words with as many substitutions as similarity allows, one at most."""
        if n - 1 < self.similarity * n:
            return ("1" * n,)
        within = tuple("1" * i + "0" + "1" * (n - 1 - i) for i in range(1, n - 1))
        return ("1" * (n - 1), *within)


def word_hashes(text: str) -> str:
    """SQL for the hashes of a text's words: runs of letters and digits in lower case."""
    words = f"filter(split(lower(coalesce({text}, '')), '[^\\\\p{{L}}\\\\p{{N}}]+'), w -> w <> '')"
    return f"transform({words}, w -> xxhash64(w))"


def seeds(rows: DataFrame, hashes: str, masks: tuple[str, ...]) -> DataFrame:
    """rows with __at (0-based place of a window) and __seed, one for each mask that fits there."""
    each = ", ".join(
        f"case when __at + {len(mask)} <= size({hashes}) then xxhash64({k}, "
        + ", ".join(f"get({hashes}, __at + {i})" for i, c in enumerate(mask) if c == "1")
        + ") end"
        for k, mask in enumerate(masks)
    )
    return (
        # the outer form, as a filter on the array would be pushed below and split every text again
        rows.select("*", F.expr(f"posexplode_outer({hashes}) as (__at, __word)"))
        .where(F.col("__at") <= F.size(hashes) - min(map(len, masks)))
        .select("*", F.expr(f"explode(array({each})) as __seed"))
        .where("__seed is not null")
        .drop("__word")
    )


def leaks(docs: DataFrame, benchmark: DataFrame, how: Overlap = Overlap()) -> DataFrame:
    """One row for each document and benchmark item that it holds, in whole or in part.

    doc_id, item_id, n_hits (seed hits at the best offset), n_words (words compared: the item's words that lie in the
    document), n_equal (equal ones), best_window (equal words in the best window), similarity (best_window by the
    window's words), doc_start (0-based word of the document where the item's first word lies, negative if that is cut
    off).

    Null or empty texts and items, and items of fewer words than how.shortest, match nothing. Repeated documents and
    items are reported once for each pair of ids. Other columns aren't read. Whole texts are read; there is no cap on
    windows, hits or items. Benchmark seeds are broadcast up to broadcast_mb; beyond that they are joined by shuffle.
    Items under eight words are looked for with masks of their length, if there are any.
    """
    words = benchmark.select(F.col("item_id").alias("__item"), F.expr(word_hashes("text")).alias("__words"))
    words = words.where(F.size("__words") >= how.shortest)
    # one row for each length under eight, and one for all others: what they hold at most
    kinds = words.groupBy(F.least(F.size("__words"), F.lit(SHORT)).alias("n")).agg(
        F.sum(F.expr("8D * size(__words) * (size(__words) + 6)")).alias("bytes"), F.max(F.size("__words")).alias("longest")
    )
    texts = docs.select("doc_id", F.expr(word_hashes("text")).alias("__h"))
    parts = []
    for r in sorted(kinds.collect()):
        masks = how.masks if r["n"] >= SHORT else how.short_masks(r["n"])
        items = words.where(F.least(F.size("__words"), F.lit(SHORT)) == r["n"])
        few = len(masks) * r["bytes"] <= how.broadcast_mb * 1e6
        parts.append(_hits(texts, items, masks, r["longest"], few))
    if not parts:
        parts = [_hits(texts, words, how.masks, 1, True)]
    hits = parts[0]
    for more in parts[1:]:
        hits = hits.unionByName(more)
    return _judged(hits, how)


def _hits(texts: DataFrame, items: DataFrame, masks: tuple[str, ...], longest: int, few: bool) -> DataFrame:
    """Where a seed of an item and one of a document are equal: (doc_id, item_id, doc_start, and the words of both)."""
    span = max(map(len, masks))
    wanted = seeds(items, "__words", masks).select(
        "__seed", "__item", F.col("__at").alias("__item_at"), F.col("__words").alias("__item_words")
    )
    have = seeds(texts, "__h", masks)
    if few:
        hits = have.join(F.broadcast(wanted), "__seed")
    else:
        # the words around a window travel with its seed: as many as the longest item can need
        low = f"greatest(0, __at - {longest})"
        near = have.withColumn("__h", F.expr(f"slice(__h, {low} + 1, 2 * {longest} + {span})"))
        near = near.withColumn("__cut", F.expr(low)).withColumn("__at", F.expr("__at - __cut"))
        hits = near.join(wanted, "__seed")
    cut = F.lit(0) if few else F.col("__cut")
    low = "greatest(0, __item_at - __at)"
    n = f"least(size(__item_words) - {low}, size(__h) - greatest(0, __at - __item_at))"
    return hits.select(
        "doc_id",
        F.col("__item").alias("item_id"),
        (F.col("__at") - F.col("__item_at") + cut).alias("doc_start"),
        F.expr(f"slice(__item_words, {low} + 1, {n})").alias("__ours"),
        F.expr(f"slice(__h, greatest(0, __at - __item_at) + 1, {n})").alias("__theirs"),
        F.size("__item_words").alias("__size"),
    )


def _judged(hits: DataFrame, how: Overlap) -> DataFrame:
    """The best offset of each document and item whose best window is similar enough. Of each hit only the words side by
    side come here; a document's hits on one offset are one comparison."""
    offsets = (
        hits.withColumn("__window", F.least(F.lit(how.window), F.col("__size")))
        .groupBy("doc_id", "item_id", "doc_start")
        .agg(*[F.first(c).alias(c) for c in ("__ours", "__theirs", "__window")], F.count("*").alias("n_hits"))
        .withColumn("__equal", F.expr("zip_with(__ours, __theirs, (x, y) -> cast(x = y as int))"))
    )
    total = "aggregate({}, 0, (s, x) -> s + x)"
    best = (
        "array_max(transform(sequence(1, greatest(1, size(__equal) - __window + 1)), "
        f"i -> {total.format('slice(__equal, i, __window)')}))"
    )
    offsets = offsets.select(
        "doc_id",
        "item_id",
        "doc_start",
        "n_hits",
        F.size("__equal").alias("n_words"),
        F.expr(total.format("__equal")).alias("n_equal"),
        F.expr(best).alias("best_window"),
        "__window",
    ).where(F.col("best_window") >= how.similarity * F.col("__window"))
    best_offset = offsets.groupBy("doc_id", "item_id").agg(
        F.max(F.struct("best_window", "n_equal", "n_hits", "n_words", "__window", "doc_start")).alias("b")
    )
    return best_offset.select(
        "doc_id",
        "item_id",
        "b.n_hits",
        "b.n_words",
        "b.n_equal",
        "b.best_window",
        (F.col("b.best_window") / F.col("b.__window")).alias("similarity"),
        "b.doc_start",
    )


def clean(docs: DataFrame, benchmark: DataFrame, how: Overlap = Overlap()) -> DataFrame:
    """docs without those that hold a benchmark item; columns stay, whatever their names.

    A row without a doc_id is judged by its own text. Of rows that share a doc_id all go if one is contaminated.
    """
    id_, held = "doc_id", _free("__held", docs.columns)
    own, text = _free("__own", docs.columns), F.coalesce(F.col("text"), F.lit(""))
    # rows without an id are known by their text's checksum; the second column tells which of the two it is
    name = F.when(F.col(id_).isNull(), F.sha2(text.cast("binary"), 256)).otherwise(F.col(id_).cast("string"))
    named = docs.withColumn(own, F.struct(F.col(id_).isNull().alias("nameless"), name.alias("name")))
    found = leaks(named.select(F.col(own).alias("doc_id"), "text"), benchmark, how)
    gone = found.select(F.col("doc_id").alias(held)).distinct()
    kept = named.join(gone, F.col(own) == F.col(held), "left_anti")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def _free(name: str, columns: list[str]) -> str:
    """name, or the first like it that no column has."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name
