"""Exact Jaccard join of documents' shingle sets by rare-first prefix filtering.

Sets are ordered by how rare their shingles are, and only a short prefix of each is joined. Pairs must pass a length, a
positional and a suffix filter before the sets are compared, once. Equal sets are one node. The join runs in two turns.
First every set meets one hub of each of its prefix shingles: among sets of like size the one with the fewest rarer
shingles, which is the most central of a group of copies, so a group is tied together by a few links a member. Then only
sets that those links leave in different components meet, in cells of bounded size, where all filters hold
before a pair is made. A pair inside a component can't change the components, so none that matters is lost, and a group
of copies never spells out its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuelight.llm.common import SMALL, components, packed, parts_of, shingles, stored, summed, word_hashes

_CHUNK = 1 << 18
#: Bits of a set's signature: bit i is the parity of its shingles that fall to i.
_SIGNATURE = 1024


@dataclass(frozen=True)
class Threshold:
    """Two sets link when percent of their union is common. counters, words: shingle and word counters, as powers of
    two, in the tables that order shingles. heavy: how many of the most copied sets are told to all tasks, so that
    their copies are left out early. hot: a shingle whose counter exceeds the usual one by more than this is joined in a
    way that splits its rows. cell: sets of a shingle that meet at a time. told_rows: up to so many ids are broadcast;
    beyond, rows are joined by shuffle."""

    percent: int = 80
    shingle: int = 5
    counters: int = 22
    words: int = 18
    heavy: int = 10_000
    heavy_copies: int = 16
    hot: int = 2000
    cell: int = 1024
    told_rows: int = 1_000_000

    def common(self, a, b):
        """The least overlap of linked sets of a and b shingles."""
        whole = 100 + self.percent
        return (self.percent * (a + b) + whole - 1) // whole

    def probe_prefix(self, n: int) -> int:
        return n - (self.percent * n + 99) // 100 + 1

    def index_prefix(self, n: int) -> int:
        return n - int(self.common(n, n)) + 1


def shingle_set(text: str | None, k: int) -> np.ndarray:
    return np.unique(shingles(word_hashes(text), k))


def _keys(own: np.ndarray) -> tuple[int, int]:
    """Two independent signed 64-bit hashes of a set."""
    whole = xxhash.xxh3_128_intdigest(own.tobytes())
    return (whole >> 64) - (1 << 63), (whole & ((1 << 64) - 1)) - (1 << 63)


def _told_apart(own: np.ndarray, alike: set[int]) -> int:
    """The key of a set; sets whose first hashes clash, as digests() finds, get another one of both hashes."""
    key, check = _keys(own)
    return xxhash.xxh3_64_intdigest(f"{key} {check}") - (1 << 63) if key in alike else key


class Order:
    """Rare first: by the counter of a shingle, as far as it stands out of the noise of counters that many shingles
    share, then by how rare its words are, then by its hash. However large the corpus, frequent passages and frequent
    words come last; any order gives the same links."""

    def __init__(self, counts: np.ndarray, words: np.ndarray, how: Threshold):
        usual = float(np.median(counts)) if len(counts) else 0.0
        self.how = how
        self.hot = how.hot + usual + 6 * usual**0.5
        self.counts = np.minimum(counts, 2**32 - 1).astype(np.uint32)
        self.step = max(1.0, 3 * usual**0.5)
        self.logs = np.log1p(words).astype(np.float32)

    def prefix(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(all shingles, the probing prefix in order, whether each of it is hot) of a text's word hashes."""
        how, every = self.how, shingles(hashes, self.how.shingle)
        own, first = np.unique(every, return_index=True)
        often = self.counts[(own >> np.uint64(64 - how.counters)).astype(np.int64)]
        total = np.concatenate([[0.0], np.cumsum(self.logs[(hashes >> np.uint64(64 - how.words)).astype(np.int64)], dtype=np.float64)])
        run = len(hashes) - len(every) + 1
        # sums of equal runs of words must be equal, wherever they stand
        rarity = np.round(total[first + run] - total[first], 3) + 1024 * np.floor(often / self.step)
        p = how.probe_prefix(len(own))
        some = np.argpartition(rarity, p - 1)[:p] if p < len(own) else np.arange(len(own))
        # all that are as frequent as the last one, so that ties are broken by the hash alone
        some = np.flatnonzero(rarity <= rarity[some].max())
        some = some[np.lexsort((own[some], rarity[some]))][:p]
        return own, own[some], often[some] > self.hot


def digests(docs: DataFrame, how: Threshold) -> tuple[DataFrame, Order, set[int]]:
    """(doc_id, key, n) of every row, where equal sets have equal keys, the order of shingles, and the first hashes
    that unequal sets share (at 10^10 sets a handful, checked by a second hash)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get().partitionId()
        seen, words = np.zeros(1 << how.counters, np.uint32), np.zeros(1 << how.words, np.uint32)
        for pdf in parts_of(batches):
            keys, checks, sizes = [], [], []
            every, found = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
            for text in pdf["text"]:
                hashes = word_hashes(text)
                own = np.unique(shingles(hashes, how.shingle))
                every.append(own)
                found.append(hashes)
                key, check = _keys(own) if len(own) else (None, None)
                keys.append(key)
                checks.append(check)
                sizes.append(len(own))
            at = (np.concatenate(every) >> np.uint64(64 - how.counters)).astype(np.int64)
            np.add.at(seen, at, np.uint32(1))
            at = (np.concatenate(found) >> np.uint64(64 - how.words)).astype(np.int64)
            words += np.bincount(at, minlength=len(words)).astype(np.uint32)
            none = pd.array([None] * len(keys), "Int32")
            yield pd.DataFrame(
                {
                    "doc_id": pdf["doc_id"].astype("Int64"),
                    "key": pd.array(keys, "Int64"),
                    "check": pd.array(checks, "Int64"),
                    "n": pd.array(sizes, "Int32"),
                    "chunk": none,
                    "task": none,
                    "counts": None,
                }
            )
        parts = [packed(table[i : i + _CHUNK]) for table in (seen, words) for i in range(0, len(table), _CHUNK)]
        none = pd.array([None] * len(parts), "Int64")
        yield pd.DataFrame(
            {
                "doc_id": none,
                "key": none,
                "check": none,
                "n": none.astype("Int32"),
                "chunk": pd.array(range(len(parts)), "Int32"),
                "task": pd.array([task] * len(parts), "Int32"),
                "counts": parts,
            }
        )

    got = stored(docs.mapInPandas(run, "doc_id long, key long, check long, n int, chunk int, task int, counts binary"))
    parts = got.where("chunk is not null").select("chunk", "task", "counts")
    tasks = (parts.agg(F.max("task")).first()[0] or 0) + 1
    every = summed(parts, tasks)
    if not len(every):
        every = np.zeros((1 << how.counters) + (1 << how.words), np.int64)
    order = Order(every[: 1 << how.counters], every[1 << how.counters :], how)
    rows = got.where("chunk is null")
    clash = rows.where("key is not null").groupBy("key").agg(F.min("check").alias("a"), F.max("check").alias("b"))
    # two of 2^64 hashes: a handful at most, whatever the corpus
    alike = {r["key"] for r in clash.where("a <> b").select("key").collect()}
    key = F.col("key")
    if alike:

        @F.pandas_udf("long")
        def apart(key: pd.Series, check: pd.Series) -> pd.Series:
            both = zip(key.tolist(), check.tolist())
            return pd.Series([xxhash.xxh3_64_intdigest(f"{k} {c}") - (1 << 63) for k, c in both])

        key = F.when(key.isin(list(alike)), apart("key", "check")).otherwise(key)
    return rows.select("doc_id", key.alias("key"), "n"), order, alike


def postings(docs: DataFrame, order: Order, alike: set[int], copies: dict[int, int], how: Threshold) -> DataFrame:
    """(tok, key, size, pos, hot): the probing prefix of every set, rarest shingles first."""
    shared = docs.sparkSession.sparkContext.broadcast((order, alike, copies))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        order, alike, copies = shared.value
        seen = set()
        for pdf in parts_of(batches):
            toks, keys, sizes, hot = [], [], [], []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                hashes = word_hashes(text)
                if not len(hashes):
                    continue
                own, prefix, often = order.prefix(hashes)
                key = _told_apart(own, alike)
                if key in seen or copies.get(key) not in (None, doc_id):
                    continue
                if len(seen) < 250_000:
                    seen.add(key)
                toks.append(prefix)
                hot.append(often)
                keys.append(key)
                sizes.append(len(own))
            n = np.array([len(t) for t in toks], np.int64)
            yield pd.DataFrame(
                {
                    "tok": np.concatenate(toks).view(np.int64) if toks else np.zeros(0, np.int64),
                    "key": np.repeat(np.array(keys, np.int64), n),
                    "size": np.repeat(np.array(sizes, np.int32), n),
                    "pos": np.concatenate([np.arange(m, dtype=np.int32) for m in n]) if toks else np.zeros(0, np.int32),
                    "hot": np.concatenate(hot) if toks else np.zeros(0, bool),
                }
            )

    return docs.mapInPandas(run, "tok long, key long, size int, pos int, hot boolean")


def _reaches(how: Threshold) -> str:
    """SQL: a set at its place of a shingle may be linked with one of least shingles, by the positional filter."""
    return f"100L * size - {100 + how.percent}L * pos >= {how.percent}L * least"


def of_several(rows: DataFrame, how: Threshold) -> DataFrame:
    """(tok, key, size, pos) of the shingles that more than one set holds in its prefix, once for each set, but for
    sets that the positional filter keeps from even the smallest set of the shingle.

    Most shingles are rare; their rows meet in one exchange, where a window of some thousands of rows at most drops
    what stands alone. Hot ones, by the counters, are summarised with partial aggregates and joined, which Spark can
    split.
    """
    own = Window.partitionBy("tok")
    extent = [F.min("key").alias("low"), F.max("key").alias("high"), F.min("size").alias("least")]
    cold = rows.where("not hot").select(
        "tok",
        "key",
        "size",
        "pos",
        F.min("key").over(own).alias("low"),
        F.max("key").over(own).alias("high"),
        F.min("size").over(own).alias("least"),
    )
    hot = rows.where("hot").select("tok", "key", "size", "pos")
    joined = hot.join(stored(hot.groupBy("tok").agg(*extent)), "tok").dropDuplicates(["tok", "key"])
    found = cold.where("low <> high").dropDuplicates(["tok", "key"]).unionByName(joined.where("low <> high"))
    return found.where(_reaches(how)).drop("low", "high", "least")


def _signature(own: np.ndarray) -> bytes:
    place = ((own >> np.uint64(7)) & np.uint64(_SIGNATURE - 1)).astype(np.int64)
    return np.packbits(np.bincount(place, minlength=_SIGNATURE) & 1).tobytes()


def sets(docs: DataFrame, alike: set[int], how: Threshold, whole: bool) -> DataFrame:
    """(key, sig) of every set of a task, or (key, shingles) if whole."""
    column, kind = ("shingles", "array<long>") if whole else ("sig", "binary")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = set()
        for pdf in parts_of(batches):
            rows = []
            for text in pdf["text"]:
                own = shingle_set(text, how.shingle)
                if len(own) and (key := _told_apart(own, alike)) not in seen:
                    seen.add(key)
                    rows.append((key, own.view(np.int64) if whole else _signature(own)))
            yield pd.DataFrame(rows, columns=["key", column])

    return docs.mapInPandas(run, f"key long, {column} {kind}")


def _need(how: Threshold) -> str:
    whole = 100 + how.percent
    return f"cast(({how.percent}L * (xsize + ysize) + {whole - 1}) div {whole} as int)"


def _passes(how: Threshold) -> str:
    """SQL: the length and the positional filter for x and y at their places of a common shingle."""
    return (
        f"xkey <> ykey and 100L * least(xsize, ysize) >= {how.percent}L * greatest(xsize, ysize) "
        f"and least(xsize - xpos, ysize - ypos) >= {_need(how)}"
    )


def _small(rows: DataFrame, how: Threshold) -> DataFrame:
    """rows, to be broadcast if they are few."""
    return F.broadcast(rows) if rows.count() <= how.told_rows else rows


def _spread(rows: DataFrame, own: str, by: str, other: DataFrame, how: Threshold) -> DataFrame:
    """rows joined with other, which has one row for each value of by. What many rows share is copied to as many cells
    as hold them all, dealt by a hash of own, so that no task gets the rows of one value."""
    n = stored(rows.groupBy(by).agg((1 + F.expr(f"count(*) div {how.cell}")).alias("__cells")))
    many = _small(n.where("__cells > 1"), how)
    dealt = rows.join(many, by, "left").withColumn(
        "__cell", F.expr(f"cast(pmod(xxhash64({own}), coalesce(__cells, 1)) as int)")
    )
    copied = other.join(many, by, "left").withColumn(
        "__cell", F.explode(F.expr("sequence(0, cast(coalesce(__cells, 1) as int) - 1)"))
    )
    return dealt.drop("__cells").join(copied.drop("__cells"), [by, "__cell"]).drop("__cell")


def _holders(keys: DataFrame, reps: DataFrame, docs: DataFrame, how: Threshold) -> DataFrame:
    """The documents that stand for some of the keys."""
    named = stored(keys.distinct().join(reps, "key").select("doc_id").distinct())
    return docs.join(_small(named, how), "doc_id", "left_semi")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key")))


def verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, alike: set[int], how: Threshold, filtered: bool) -> DataFrame:
    """Those of the pairs (a, b) of keys whose sets are similar enough; reps: (key, doc_id) of a document for each key.

    The suffix filter bounds the difference of two sets by that of their signatures; only sets of pairs that pass it
    (or have passed it: filtered) are made in whole. Ids are broadcast up to told_rows, beyond that joined by shuffle.
    """
    whole = 100 + how.percent
    near = pairs = stored(pairs)
    if not filtered:
        sig = stored(sets(_holders(_ends(pairs), reps, docs, how), alike, how, False))
        met = _spread(
            _small(pairs, how).join(sig.select(F.col("key").alias("a"), F.col("sig").alias("asig")), "a"),
            "a",
            "b",
            sig.select(F.col("key").alias("b"), F.col("sig").alias("bsig")).join(
                _small(pairs.select("b").distinct(), how), "b", "left_semi"
            ),
            how,
        )

        @F.pandas_udf("int")
        def apart(x: pd.Series, y: pd.Series) -> pd.Series:
            return pd.Series(_differ(_bits(x), _bits(y)))

        near = stored(
            met.where(apart("asig", "bsig") <= F.expr(f"xsize + ysize - 2 * {_need(how)}")).select("a", "b")
        )
    own = stored(sets(_holders(_ends(near), reps, docs, how), alike, how, True))
    return stored(
        _spread(
            _small(near.select("a", "b"), how).join(own.select(F.col("key").alias("a"), F.col("shingles").alias("s")), "a"),
            "a",
            "b",
            own.select(F.col("key").alias("b"), F.col("shingles").alias("t")).join(
                _small(near.select("b").distinct(), how), "b", "left_semi"
            ),
            how,
        )
        .select("a", "b", F.size(F.array_intersect("s", "t")).alias("n"), (F.size("s") + F.size("t")).alias("both"))
        .where(f"{whole}L * n >= {how.percent}L * both")
        .select("a", "b")
        .distinct()  # a doc_id that comes more than once gives its set more than once
    )


def _bits(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint64).reshape(-1, _SIGNATURE // 64)


def _differ(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many bits signatures differ: never more than the sets differ in shingles."""
    return np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int32)


def hub_pairs(several: DataFrame, how: Threshold) -> DataFrame:
    """(a, b, xsize, ysize): each set with the hubs of its prefix shingles, those of its size and of the size below.

    A hub is the set of a shingle with the fewest rarer shingles, the smaller one of equal ones: what holds a passage
    and little else. Sizes of one class differ by less than the threshold allows.
    """
    size_class = F.floor(F.log(F.col("size").cast("double")) / F.log(F.lit(100.0 / how.percent))).cast("int")
    rows = several.withColumn("cls", size_class)
    hub = F.min(F.struct("pos", "size", "key")).alias("hub")
    hubs = rows.groupBy("tok", "cls").agg(hub, F.count("*").alias("n"))
    hubs = stored(hubs).select("tok", F.explode(F.expr("array(cls, cls + 1)")).alias("cls"), "hub")
    return (
        rows.select("tok", "cls", *[F.col(c).alias(f"x{c}") for c in ("key", "size", "pos")])
        .join(hubs, ["tok", "cls"])
        .select("xkey", "xsize", "xpos", *[F.col(f"hub.{c}").alias(f"y{c}") for c in ("key", "size", "pos")])
        .where(_passes(how))
        .groupBy(F.greatest("xkey", "ykey").alias("a"), F.least("xkey", "ykey").alias("b"))
        .agg(F.first("xsize").alias("xsize"), F.first("ysize").alias("ysize"))
    )


def apart(several: DataFrame, joined: DataFrame) -> DataFrame:
    """(tok, key, size, pos, component) of the shingles whose sets are in more than one component."""
    left = several.join(_small_stars(joined), "key", "left").withColumn("component", F.coalesce("component", "key"))
    left = stored(left)
    groups = left.groupBy("tok").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    split = stored(groups.where("low <> high").select("tok"))
    return left.join(split, "tok", "left_semi")


def _small_stars(joined: DataFrame) -> DataFrame:
    return F.broadcast(joined) if joined.count() <= SMALL else joined


def _celled(left: DataFrame, how: Threshold, *more: str) -> DataFrame:
    """Rows of a shingle dealt into blocks by a hash, and each two blocks into a cell (tok, i, j) of its own."""
    n = stored(left.groupBy("tok").agg((1 + F.expr(f"count(*) div {how.cell}")).alias("blocks")).where("blocks > 1"))
    rows = (
        left.join(n, "tok", "left")
        .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("block", F.expr("pmod(xxhash64(key), blocks)"))
        .withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
        .select(
            "tok",
            F.least("block", "other").alias("i"),
            F.greatest("block", "other").alias("j"),
            "block",
            "key",
            "size",
            "pos",
            "component",
            *more,
        )
    )
    return rows.repartition("tok", "i", "j").sortWithinPartitions("tok", "i", "j")


def _meeting(how: Threshold, signed: bool):
    """Over rows sorted by cell: of each two sets of other components (and of other blocks where a cell holds two) that
    pass the length and positional filters, the rows of both; if signed, the keys of the pairs that pass the suffix
    filter, too."""
    whole = 100 + how.percent

    def pairs(rows: pd.DataFrame) -> pd.DataFrame:
        cell = rows[["tok", "i", "j"]].to_numpy()
        new = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]).any(axis=1)]))
        ends = np.repeat(np.append(new[1:], len(rows)), np.diff(np.append(new, len(rows))))
        key, component = rows["key"].to_numpy(), rows["component"].to_numpy()
        size, pos = rows["size"].to_numpy(np.int64), rows["pos"].to_numpy(np.int64)
        block, crossing = rows["block"].to_numpy(), cell[:, 1] != cell[:, 2]
        bits = _bits(rows["sig"]) if signed else None
        alive = np.zeros(len(rows), bool)
        found, x, step = [np.zeros((0, 2), np.int64)], np.arange(len(rows)), 0
        while True:
            step += 1
            x = x[x + step < ends[x]]
            if not len(x):
                break
            y = x + step
            ok = (component[x] != component[y]) & (~crossing[x] | (block[x] != block[y]))
            a, b = x[ok], y[ok]
            larger = (size[a] > size[b]) | ((size[a] == size[b]) & (key[a] > key[b]))
            a, b = np.where(larger, a, b), np.where(larger, b, a)
            need = (how.percent * (size[a] + size[b]) + whole - 1) // whole
            ok = (100 * size[b] >= how.percent * size[a]) & (np.minimum(size[a] - pos[a], size[b] - pos[b]) >= need)
            # the smaller set's shingle must be in its shorter prefix
            ok &= pos[b] < size[b] - (2 * how.percent * size[b] + whole - 1) // whole + 1
            a, b, need = a[ok], b[ok], need[ok]
            if signed:
                ok = _differ(bits[a], bits[b]) <= size[a] + size[b] - 2 * need
                found.append(np.stack([np.maximum(key[a[ok]], key[b[ok]]), np.minimum(key[a[ok]], key[b[ok]])], 1))
            else:
                alive[a] = alive[b] = True
        if signed:
            return pd.DataFrame(np.unique(np.concatenate(found), axis=0), columns=["a", "b"])
        return rows.loc[alive, ["tok", "key", "size", "pos", "component"]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            last = held.iloc[-1]
            open_ = ((held["tok"] == last["tok"]) & (held["i"] == last["i"]) & (held["j"] == last["j"])).to_numpy()
            if not open_.all():
                yield pairs(held[~open_])
                held = held[open_].reset_index(drop=True)
        if held is not None and len(held):
            yield pairs(held)

    return run


def cell_pairs(left: DataFrame, reps: DataFrame, docs: DataFrame, alike: set[int], how: Threshold) -> DataFrame:
    """(a, b) of sets of different components that pass the length, positional and suffix filters.

    The sets of a shingle are cut into blocks, and each two blocks meet in a cell of its own: a task never holds more
    than one cell, and a pair becomes a row only when it has passed the filters. Sets without any partner by length and
    place are left out first, so that few need a signature.
    """
    rows = _celled(left, how).mapInPandas(_meeting(how, False), "tok long, key long, size int, pos int, component long")
    rows = stored(rows.distinct())
    sig = stored(sets(_holders(rows.select("key"), reps, docs, how), alike, how, False).dropDuplicates(["key"]))
    return _celled(rows.join(sig, "key"), how, "sig").mapInPandas(_meeting(how, True), "a long, b long").distinct()


def classes(docs: DataFrame, how: Threshold = Threshold()) -> DataFrame:
    """doc_id, n_shingles and component_id of every row: the smallest doc_id that links reach.

    Rows without words have no shingles and their own doc_id; so has a row that nothing links to. Repeated rows and
    equal texts share a component. Rows without a doc_id have no component and link nothing. Other columns aren't read. An
    empty table gives an empty table. Whole texts are read. Nothing of the corpus reaches the driver but tables of
    counters of fixed size and at most ``heavy`` keys.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    digest, order, alike = digests(docs, how)
    # of an all-null group any row stands for the rest; only named rows can be left out
    copied = (
        digest.where("key is not null and doc_id is not null")
        .groupBy("key")
        .agg(F.count("*").alias("n"), F.min("doc_id").alias("rep"))
    )
    copied = stored(copied)
    most = copied.where(F.col("n") >= how.heavy_copies).orderBy(F.desc("n"), "key").limit(how.heavy).collect()
    told = {r["key"]: r["rep"] for r in most}
    several = stored(of_several(stored(postings(docs.where("doc_id is not null"), order, alike, told, how)), how))

    names = copied.select("key", F.col("rep").alias("doc_id"))
    first = verified(hub_pairs(several, how), names, docs, alike, how, False)
    joined = components(first).select(F.col("id").alias("key"), "component")
    left = stored(apart(several, joined))
    second = verified(cell_pairs(left, names, docs, alike, how), names, docs, alike, how, True)
    if second.isEmpty():
        linked = joined
    else:
        linked = components(first.unionByName(second)).select(F.col("id").alias("key"), "component")

    # only sets with links can have another document's id
    named = stored(linked.join(names, "key"))
    least = stored(named.groupBy("component").agg(F.min("doc_id").alias("component_id")))
    named = _spread(named.select("key", "component"), "key", "component", least, how).select("key", "component_id")
    named = names.join(named, "key", "left").select("key", F.coalesce("component_id", "doc_id").alias("component_id"))
    return digest.join(named, "key", "left").select(
        "doc_id",
        F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
    )


def representatives(docs: DataFrame, how: Threshold = Threshold()) -> DataFrame:
    """One document of each component: the one with the smallest doc_id; columns stay.

    Rows without a doc_id stay, as nothing can name them. Rows without words are no copies of one another and stay.
    Of rows with an equal doc_id one stays if they are equal in text.
    """
    found = stored(classes(docs, how))
    kept = found.where("component_id = doc_id").select("doc_id").distinct()
    again = stored(found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))

    def few(ids: DataFrame) -> DataFrame:
        return F.broadcast(ids) if ids.count() <= how.told_rows else ids

    named = docs.join(few(kept), "doc_id", "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
    if not again.isEmpty():  # only rows whose doc_id comes more than once need their texts compared
        every = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
        repeated = (
            named.join(few(again), "doc_id", "left_semi")
            .groupBy("doc_id", "text")
            .agg(F.min_by(every, F.xxhash64(F.to_json(every))).alias("__row"))
            .select("__row.*")
        )
        named = named.join(few(again), "doc_id", "left_anti").unionByName(repeated)
    return named.select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(docs.where("doc_id is null"))
