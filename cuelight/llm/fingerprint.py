"""Document fingerprints by one-permutation MinHash, in DataFrame functions alone.

Every shingle is hashed once; the top bits of the hash choose a bin and the least hash of each bin stays. An empty bin
borrows from a full one that a hash of its own number chooses, by double hashing over all bins (optimal
densification). Of each bin the four low-order bits are kept, packed into 64-bit words; the share of equal bins is
corrected for bins that agree by chance.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN_BITS = 8
BINS = 1 << BIN_BITS
BITS = 4
SHINGLE = 5
_SHIFT = 64 - BIN_BITS
_REST = (1 << _SHIFT) - 1


def _turns() -> tuple[list[int], list[int]]:
    """Where each bin begins to look, and its odd stride: two fixed pseudo-random numbers of the bin."""
    mixed = [(b * 0x9E3779B97F4A7C15 + 0x7F4A7C15) * 0xBF58476D1CE4E5B9 % (1 << 64) for b in range(BINS)]
    return [(m >> 50) % BINS for m in mixed], [(m >> 40) % BINS | 1 for m in mixed]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprinted(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with column out: an array of BINS * BITS / 64 longs; empty for texts without words.

    Words are runs of anything but ASCII white space, in lower case; shingles are of five words, and fewer words make
    one shingle. Null counts as empty.
    """
    w, h, s, o, d = (f"__{out}_{x}" for x in "whsod")
    following = ", ".join(f"{h}[i + {k}]" for k in range(1, SHINGLE))
    # one last hash for each bin: after sorting every bin has a first one, and an empty bin's is this
    stops = F.array(*[F.lit(_signed((b << _SHIFT) | _REST)) for b in range(BINS)])
    kept = [F.col(f"`{c}`") for c in df.columns]
    step = df.withColumn(w, F.expr(f"filter(split(lower(coalesce(`{text}`, '')), '[ \\\\t-\\\\r]+'), w -> w <> '')"))
    step = step.withColumn(h, F.expr(f"transform({w}, w -> xxhash64(w))"))
    step = step.withColumn(
        s,
        F.expr(
            f"case when size({h}) = 0 then cast(array() as array<bigint>) when size({h}) < {SHINGLE} "
            f"then array(xxhash64({h})) "
            f"else transform(slice({h}, 1, size({h}) - {SHINGLE - 1}), (x, i) -> xxhash64(x, {following})) end"
        ),
    )
    step = step.withColumn(o, F.sort_array(F.concat(F.col(s), stops)))
    bin_of = lambda x: f"shiftrightunsigned({x}, {_SHIFT})"
    step = step.withColumn(
        d, F.expr(f"filter({o}, (x, i) -> i = 0 or {bin_of('x')} <> {bin_of(f'{o}[i - 1]')})")
    )
    full = lambda x: f"({x} & {_REST}L) <> {_REST}L"
    # an empty bin i looks at bins by double hashing, which visits each once in BINS turns, until one is full;
    # a few turns are tried before all of them
    begin, stride = (f"array({', '.join(map(str, v))})" for v in _turns())
    at = lambda j: f"{d}[({begin}[i] + {j} * {stride}[i]) % {BINS}]"
    first = lambda n: f"get(filter(sequence(1, {n}), j -> {full(at('j'))}), 0)"
    # what is lent is hashed with the bin's number, so that the low bits of bins with one source agree independently
    lent = f"xxhash64({at(f'coalesce({first(8)}, {first(64)}, {first(BINS)})')}, i)"
    low = f"transform({d}, (x, i) -> (case when {full('x')} then x else {lent} end) & {(1 << BITS) - 1}L)"
    none = "cast(array() as array<bigint>)"
    per, n = 64 // BITS, f"__{out}_n"
    step = step.withColumn(n, F.expr(f"case when size({s}) = 0 then {none} else {low} end"))
    word = "aggregate(slice({n}, {at}, {per}), 0L, (a, x) -> shiftleft(a, {bits}) | x)"
    every = ", ".join(word.format(n=n, at=k * per + 1, per=per, bits=BITS) for k in range(BINS // per))
    packed = f"case when size({n}) = 0 then {none} else array({every}) end"
    return step.withColumn(out, F.expr(packed)).select(*kept, out)


def told(fingerprint: str) -> Column:
    """A fingerprint as hexadecimal digits, one for each bin."""
    return F.expr(f"array_join(transform({fingerprint}, x -> lpad(lower(hex(x)), 16, '0')), '')")


def likeness(a: str, b: str) -> Column:
    """The estimated Jaccard similarity of two fingerprints, 0 to 1; two without words are alike, one is unlike."""
    ones = sum(1 << (BITS * k) for k in range(64 // BITS))
    some = "(x | shiftrightunsigned(x, 1) | shiftrightunsigned(x, 2) | shiftrightunsigned(x, 3))"
    differ = (
        f"aggregate(transform(zip_with({a}, {b}, (x, y) -> x ^ y), x -> bit_count({some} & {ones}L)), 0, (n, x) -> n + x)"
    )
    chance = 2.0**-BITS
    share = f"(1.0D - {differ} / {float(BINS)}D)"
    return F.expr(
        f"case when size({a}) = 0 and size({b}) = 0 then 1.0D when size({a}) = 0 or size({b}) = 0 then 0.0D "
        f"else least(1.0D, greatest(0.0D, ({share} - {chance}D) / {1 - chance}D)) end"
    )


def with_next(
    docs: DataFrame,
    carried: list[str],
    buckets: int,
    prepare: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> DataFrame:
    """docs(doc_id, ...) with __next_<c> for each carried column c: that of the next row by descending doc_id, and
    after the last row that of the first.

    Rows are dealt into buckets of consecutive ids by approximate quantiles and ordered within them. Each bucket also
    gets a copy of the row that follows its last one, so that a window over the bucket sees every successor, and no
    task ever orders the whole table. Ties of doc_id are ordered by the row's other values; a null id comes last.
    What prepare adds to a row is carried too; it runs before rows are dealt out.
    """
    bounds = docs.agg(
        F.percentile_approx("doc_id", [k / buckets for k in range(1, buckets)], 10 * buckets).alias("b")
    ).first()["b"]
    bounds = sorted(set(bounds or []), reverse=True)
    edges = F.array(*[F.lit(b) for b in bounds]) if bounds else F.expr("cast(array() as array<bigint>)")
    row = F.struct(F.col("doc_id"), *[F.col(c) for c in carried])
    dealt = docs.select(
        "*",
        F.when(F.col("doc_id").isNull(), len(bounds)).otherwise(
            F.size(F.filter(edges, lambda b: b > F.col("doc_id")))
        ).alias("__bucket"),
    )
    heads = dealt.groupBy("__bucket").agg(F.max(row).alias("__row"))
    present = sorted(r["__bucket"] for r in heads.select("__bucket").collect())  # at most as many as buckets
    before = dict(zip(present, [*present[-1:], *present[:-1]]))
    if before:
        to = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])
        heads = heads.select(to[F.col("__bucket")].alias("__bucket"), "__row.*", F.lit(1).alias("__copy"))
        dealt = dealt.withColumn("__copy", F.lit(0)).unionByName(heads, allowMissingColumns=True)
    else:
        dealt = dealt.withColumn("__copy", F.lit(0))
    ready = prepare(dealt)
    every = [*carried, *[c for c in ready.columns if c not in dealt.columns]]
    order = Window.partitionBy("__bucket").orderBy(
        "__copy", F.col("doc_id").desc_nulls_last(), *[F.col(c).desc_nulls_last() for c in carried]
    )
    return ready.select("*", *[F.lead(c).over(order).alias(f"__next_{c}") for c in every]).where("__copy = 0")


def edited_pairs(docs: DataFrame) -> DataFrame:
    """The texts, their edited texts, and the fingerprints of both and of the next document.

    An edited text keeps the first half of the text (the longer half of an odd length) and goes on with the start of
    the next document, as many code points as were taken away, or all of that document if it is shorter. Null texts
    count as empty. Whole texts of any length are read. Repeated rows each count as a document. An empty table gives
    an empty table; a single document is its own next one.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("__text"))
    buckets = max(64, min(4096, 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    rows = with_next(rows, ["__text"], buckets, lambda df: fingerprinted(df, "__text", "__fp"))
    half = F.floor(F.length("__text") / 2).cast("int")
    rows = rows.select(
        "*",
        F.concat(
            F.substring("__text", F.lit(1), F.length("__text") - half), F.substring("__next___text", F.lit(1), half)
        ).alias("__edited"),
    )
    return fingerprinted(rows, "__edited", "__edited_fp")
