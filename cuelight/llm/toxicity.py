"""Toxicity by nearest labelled examples.

Texts are TF-IDF vectors over words and word beginnings that labelled toxic texts use far more often than others, and
over all other words together, so that the share of such terms in the whole text counts. The nearest examples by cosine come from an inverted index whose postings are cut into blocks with their largest weights:
blocks are scored in order of their bound, and the search ends when no bound can reach the k-th best, so the result is
exact. Votes weighted by distance, corrected for how examples were drawn, are calibrated by isotonic regression of the
examples' labels on the votes that each gets from all others; the neighbours are evidence.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelight.llm.common import mapped, stored

_WORD = re.compile(r"[^\W\d_]{3,}")
PREFIXES = (4, 5, 6)
#: The term that every word without a term of its own counts as.
REST = ""


@dataclass(frozen=True)
class Settings:
    """per_class: the most examples of each label that the index holds (drawn by a hash of the id, so the sample is
    the same on every run). least_g2: the least log-likelihood ratio of a term that counts on its own; least_docs and
    least_ratio: how many toxic examples hold it, and how much oftener than others. neighbours: k. block: examples in a
    block. threshold: the score from which a text counts as toxic. step: the least weight of labelled rows that a step
    of the calibration rests on."""

    per_class: int = 3000
    least_g2: float = 24.0
    least_docs: int = 5
    least_ratio: float = 3.0
    neighbours: int = 15
    block: int = 32
    threshold: float = 0.7
    prior: float = 0.02
    step: float = 10.0


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The rising function of x nearest to y: its steps' mean x and values. Neighbours that fall are pooled, and so are
    steps of less than the least weight."""
    pools: list[list[float]] = []  # sum of weights, of weighted y, of weighted x
    order = np.argsort(x, kind="stable")
    for a, b, w in zip(x[order].tolist(), y[order].tolist(), weight[order].tolist()):
        pools.append([w, w * b, w * a])
        while len(pools) > 1 and (
            pools[-2][1] / pools[-2][0] >= pools[-1][1] / pools[-1][0] or pools[-2][0] < least
        ):
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last)]
    if len(pools) > 1 and pools[-1][0] < least:
        last = pools.pop()
        pools[-1] = [p + q for p, q in zip(pools[-1], last)]
    return np.array([p[2] / p[0] for p in pools]), np.array([p[1] / p[0] for p in pools])


def terms(word: str) -> list[str]:
    """A word and its beginnings; a star marks a beginning."""
    return [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) >= n)]


class _Known(dict):
    """word -> places of its terms in the vocabulary; forgets all once it holds too many words."""

    def __init__(self, vocabulary: dict[str, int]):
        self.vocabulary = vocabulary
        self.rest = vocabulary.get(REST)

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > 1_000_000:
            self.clear()
        found = self[word] = tuple(self.vocabulary[t] for t in terms(word) if t in self.vocabulary)
        return found


def counted(text: str | None, known: _Known) -> Counter:
    """How often each vocabulary term occurs in the whole text; empty if only other words do."""
    out: Counter = Counter()
    if text:
        words = _WORD.findall(text.lower())
        hits = list(filter(None, map(known.__getitem__, words)))
        for hit in hits:
            out.update(hit)
        if hits and known.rest is not None and len(hits) < len(words):
            out[known.rest] = len(words) - len(hits)
    return out


@dataclass
class Index:
    """Examples as unit vectors in an inverted index with block maxima."""

    vocabulary: dict[str, int]
    idf: np.ndarray
    ids: np.ndarray
    toxic: np.ndarray
    drawn: np.ndarray  # how many labelled rows an example stands for
    settings: Settings
    blank: float  # the score of a text without any term
    best: np.ndarray = field(default=None)  # terms x blocks: largest weight
    first: np.ndarray = field(default=None)  # terms x (blocks + 1): where a block's postings begin
    post_doc: np.ndarray = field(default=None)
    post_weight: np.ndarray = field(default=None)
    votes: np.ndarray = field(default=None)  # the calibration: votes and what they mean
    means: np.ndarray = field(default=None)

    def vector(self, counts: Counter) -> tuple[np.ndarray, np.ndarray]:
        at = np.fromiter(counts.keys(), np.int64, len(counts))
        w = np.fromiter(counts.values(), np.float64, len(counts)) * self.idf[at]
        return at, w / np.sqrt((w * w).sum())

    def build(self, vectors: list[Counter]) -> Index:
        """Examples with terms, ordered by their weightiest term and its weight, so that a block holds like examples."""
        rows = [self.vector(c) for c in vectors]
        rest = self.vocabulary.get(REST, -1)

        def place(i: int) -> tuple[int, float, int]:
            at, w = rows[i]
            own = np.where(at == rest, -1, w)
            return int(at[own.argmax()]), -float(own.max()), int(self.ids[i])

        order = sorted(range(len(rows)), key=place)
        self.ids, self.toxic, self.drawn = self.ids[order], self.toxic[order], self.drawn[order]
        n, size = len(order), self.settings.block
        blocks = -(-n // size)
        t = np.concatenate([rows[i][0] for i in order]) if n else np.zeros(0, np.int64)
        d = np.repeat(np.arange(n), [len(rows[i][0]) for i in order]) if n else np.zeros(0, np.int64)
        w = np.concatenate([rows[i][1] for i in order]) if n else np.zeros(0)
        by_term = np.lexsort((d, t))
        t, self.post_doc, self.post_weight = t[by_term], d[by_term], w[by_term]
        self.best = np.zeros((len(self.vocabulary), blocks))
        np.maximum.at(self.best, (t, self.post_doc // size), self.post_weight)
        key = t * (blocks + 1) + self.post_doc // size
        self.first = np.searchsorted(key, np.arange(len(self.vocabulary) * (blocks + 1))).reshape(-1, blocks + 1)
        return self

    def nearest(self, at: np.ndarray, weight: np.ndarray, besides: int = 0) -> list[tuple[float, int]]:
        """The k examples (and some besides) of largest cosine, exactly; of equal cosines those that come first."""
        k, size, n = self.settings.neighbours + besides, self.settings.block, len(self.ids)
        bound = weight @ self.best[at]
        order = np.argsort(-bound, kind="stable")
        held: list[tuple[float, int]] = []
        least = 0.0
        for lead in range(0, len(order), 4):
            some = order[lead : lead + 4]
            some = some[(bound[some] >= least - 1e-12) & (bound[some] > 0)]
            if not len(some):
                break
            scores: dict[int, float] = {}
            for b in some:
                own = np.zeros(size)
                for t, w in zip(at, weight):
                    lo, hi = self.first[t, b], self.first[t, b + 1]
                    if lo < hi:
                        own[self.post_doc[lo:hi] - b * size] += w * self.post_weight[lo:hi]
                scores |= {b * size + j: own[j] for j in np.flatnonzero(own) if b * size + j < n}
            held = sorted([*held, *((-round(s, 12), int(i)) for i, s in scores.items())])[:k]
            if len(held) == k:
                least = -held[-1][0]
        return [(-s, i) for s, i in held]

    def vote(self, counts: Counter, without: int | None = None) -> tuple[float | None, list[int]]:
        """(the share of votes for toxic, the neighbours' ids); without leaves an example out. None if nobody votes."""
        if not counts or not len(self.ids):
            return None, []
        found = self.nearest(*self.vector(counts), besides=int(without is not None))
        found = [(s, i) for s, i in found if without is None or self.ids[i] != without][: self.settings.neighbours]
        if not found:
            return None, []
        cos = np.array([s for s, _ in found])
        at = np.array([i for _, i in found])
        vote = cos / (1.02 - np.minimum(cos, 1)) * self.drawn[at]
        prior = self.settings.prior * vote.sum()
        value = ((vote * self.toxic[at]).sum() + prior * self.blank) / (vote.sum() + prior)
        return float(value), [int(x) for x in self.ids[at]]

    def calibrate(self, vectors: dict[int, Counter]) -> Index:
        """Fit what votes mean on the examples, each judged by all others."""
        got = [self.vote(vectors[int(i)], without=int(i))[0] for i in self.ids]
        some = np.array([v is not None for v in got], bool)
        if some.any():
            x = np.array([v for v in got if v is not None])
            self.votes, self.means = isotonic(x, self.toxic[some], self.drawn[some], self.settings.step)
        return self

    def score(self, counts: Counter) -> tuple[float, list[int]]:
        """(score, the neighbours' ids)."""
        value, ids = self.vote(counts)
        if value is None:
            return self.blank, []
        if self.votes is not None:
            value = float(np.interp(value, self.votes, self.means))
        return min(1.0, max(0.0, value)), ids


def examples(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> tuple[DataFrame, dict[int, float]]:
    """A bounded sample of labelled documents outside the held-out fold, and by label how many rows one stands for.

    A doc_id with several labels counts by their mean; null ids and labels are left out.
    """
    known = (
        labels.where("doc_id is not null and toxic is not null")
        .where("crc32(cast(cast(doc_id as string) as binary)) % 3 <> 1")
        .groupBy("doc_id")
        .agg((F.avg("toxic") >= 0.5).cast("int").alias("__toxic"))
    )
    total = {r["__toxic"]: r["n"] for r in known.groupBy("__toxic").agg(F.count("*").alias("n")).collect()}
    some = [
        known.where(F.col("__toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.per_class)
        for y in (0, 1)
    ]
    # at most twice per_class ids: a proven bound for the broadcast
    drawn = F.broadcast(some[0].unionByName(some[1]))
    rows = stored(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .join(drawn, "doc_id")
        .select("doc_id", "__toxic", "text")
    )
    return rows, {y: max(1.0, total.get(y, 0) / settings.per_class) for y in (0, 1)}


def vocabulary(rows: DataFrame, settings: Settings) -> list[str]:
    """Terms that toxic examples use far more often, by log-likelihood ratio."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = (Counter(), Counter())
        for pdf in batches:
            for y, text in zip(pdf["__toxic"], pdf["text"]):
                words = set(_WORD.findall((text or "").lower()))
                seen[y].update({t for w in words for t in terms(w)})
        found = list({**seen[0], **seen[1]})
        for lead in range(0, len(found), 50_000):
            keys = found[lead : lead + 50_000]
            yield pd.DataFrame({"term": keys, "clean": [seen[0][k] for k in keys], "bad": [seen[1][k] for k in keys]})

    n = {r["__toxic"]: r["n"] for r in rows.groupBy("__toxic").agg(F.count("*").alias("n")).collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    if not n0 or not n1:
        return []
    a, b = F.col("bad").cast("double"), F.col("clean").cast("double")
    share = (a + b) / F.lit(float(n0 + n1))
    part = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
    g2 = 2 * (
        part(a, share * n1) + part(b, share * n0) + part(n1 - a, (1 - share) * n1) + part(n0 - b, (1 - share) * n0)
    )
    chosen = (
        rows.mapInPandas(count, "term string, clean long, bad long")
        .groupBy("term")
        .agg(F.sum("clean").alias("clean"), F.sum("bad").alias("bad"))
        .where((a >= settings.least_docs) & (a / n1 >= settings.least_ratio * b / n0))
        .withColumn("g2", g2)
        .where(F.col("g2") >= settings.least_g2)
        .orderBy(F.desc("g2"), "term")
    )
    return [r["term"] for r in chosen.collect()]  # terms of at most twice per_class texts


def corpus_frequencies(docs: DataFrame, chosen: dict[str, int]) -> tuple[int, np.ndarray]:
    """The number of documents, and of documents with each vocabulary term, over the whole table."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, seen, n = _Known(chosen), Counter(), 0
        for pdf in batches:
            n += len(pdf)
            for text in pdf["text"]:
                seen.update(set().union(*map(known.__getitem__, _WORD.findall((text or "").lower()))))
        yield pd.DataFrame({"term": [-1, *seen], "n": [n, *seen.values()]})

    sums = docs.select("text").mapInPandas(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
    got = {r["term"]: r["n"] for r in sums.collect()}  # one row for each vocabulary term
    return got.pop(-1, 0), np.array([got.get(t, 0) for t in range(len(chosen))], dtype=np.float64)


def fitted(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Index:
    """The index over the sampled examples, with document frequencies of the whole table."""
    rows, stands_for = examples(docs, labels, settings)
    chosen = {t: i for i, t in enumerate(vocabulary(rows, settings))}
    n, df = corpus_frequencies(docs, chosen) if chosen else (0, np.zeros(0))
    if chosen:  # other words are taken to be in every document
        chosen[REST], df = len(chosen), np.append(df, n)

    def vectors(pdf: pd.DataFrame) -> pd.DataFrame:
        known = _Known(chosen)
        found = [counted(t, known) for t in pdf["text"]]
        return pd.DataFrame(
            {
                "doc_id": pdf["doc_id"],
                "toxic": pdf["__toxic"],
                "terms": [list(map(int, c.keys())) for c in found],
                "counts": [list(map(int, c.values())) for c in found],
            }
        )

    got = mapped(rows, vectors, "doc_id long, toxic int, terms array<int>, counts array<int>").collect()
    # repeated rows count once
    unique = {r["doc_id"]: r for r in got}
    got = [unique[i] for i in sorted(unique)]
    weight = lambda rs: sum(stands_for[r["toxic"]] for r in rs)
    blank = [r for r in got if not r["terms"]]
    bad = weight([r for r in blank if r["toxic"]])
    shown = [r for r in got if r["terms"]]
    index = Index(
        vocabulary=chosen,
        idf=np.log((1 + n) / (1 + df)) + 1,
        ids=np.array([r["doc_id"] for r in shown], dtype=np.int64),
        toxic=np.array([r["toxic"] for r in shown], dtype=np.float64),
        drawn=np.array([stands_for[r["toxic"]] for r in shown]),
        settings=settings,
        blank=float(bad / (weight(blank) or 1.0)),
    )
    vectors = {r["doc_id"]: Counter(dict(zip(r["terms"], r["counts"]))) for r in shown}
    return index.build([vectors[r["doc_id"]] for r in shown]).calibrate(vectors)


def _free(name: str, columns: list[str]) -> str:
    """name, or the first like it that no column has."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def scored(docs: DataFrame, index: Index, score: str = "__score", evidence: str = "__evidence") -> DataFrame:
    """docs with score (0 to 1) and evidence (doc_ids of the nearest examples, nearest first), named as asked.

    All rows and columns stay; columns of the new names are replaced. The text alone makes the score. Null and empty texts, and texts without any term of
    the vocabulary, get the share of toxic ones among the examples without any, and no evidence. Equal texts get
    equal scores. Without labels of both kinds every score is that share, or 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast(index)

    @F.pandas_udf("score double, evidence array<long>")
    def judged(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        index = shared.value
        known, memo = _Known(index.vocabulary), {}
        for texts in parts:
            out = []
            for text in texts:
                counts = counted(text, known)
                key = tuple(sorted(counts.items()))
                if key not in memo:
                    if len(memo) > 100_000:
                        memo.clear()
                    memo[key] = index.score(counts)
                out.append(memo[key])
            yield pd.DataFrame(out, columns=["score", "evidence"])

    got = _free("__got", docs.columns)
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in (score.lower(), evidence.lower())]
    every = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(*every, judged("text").alias(got))
    return rows.select(*kept, F.col(f"{got}.score").alias(score), F.col(f"{got}.evidence").alias(evidence))


def accepted(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """docs without the rows whose score reaches the threshold; columns stay as they are."""
    score, evidence = _free("__score", docs.columns), _free("__evidence", docs.columns)
    got = scored(docs, fitted(docs, labels, settings), score, evidence)
    return got.where(F.col(score) < settings.threshold).select(*[F.col(f"`{c}`") for c in docs.columns])
