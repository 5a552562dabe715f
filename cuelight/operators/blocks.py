"""Running values over a long ordered series without one task for the whole series.

A series (all rows of a key) is cut into blocks of its order column. A window works within a block; what earlier
blocks contribute comes from one summary row a block, scanned in order. A key with a third of all rows is spread over
its blocks, and the scan over summaries is as small as the number of blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of one source in a block.
BLOCK_SECONDS = 600.0


def running(
    rows: DataFrame,
    key: str,
    place: str,
    order: list[str],
    values: dict[str, tuple[str, Column]],
    width: float = BLOCK_SECONDS,
    backwards: bool = False,
) -> DataFrame:
    """rows with a column for each of values, over all earlier rows of the key (all later ones if backwards).

    place: a numeric column that order begins with. A value is ("max" | "min" | "sum" | "count", column); nulls are
    ignored, and before the first row the value is null (0 for a count). Order must tell all rows apart.

    Nothing runs when the plan is made. The rows are read twice, for the windows and for the summary, over the same
    exchange; rows that are dear to make, or values built on values, are best written first by the caller (settled).
    """
    block = f"__{'_'.join(values)}_block"
    rows = rows.withColumn(block, F.floor(F.col(place) / F.lit(float(width))))
    turn = [F.col(c).desc() if backwards else F.col(c).asc() for c in order]
    inside = Window.partitionBy(key, block).orderBy(*turn).rowsBetween(Window.unboundedPreceding, -1)
    line = F.col(block).desc() if backwards else F.col(block).asc()
    earlier = Window.partitionBy(key).orderBy(line).rowsBetween(Window.unboundedPreceding, -1)
    of = {"max": F.max, "min": F.min, "sum": F.sum, "count": F.count}
    over = {"max": F.max, "min": F.min, "sum": F.sum, "count": F.sum}
    both = {
        "max": F.greatest,
        "min": F.least,
        "sum": lambda a, b: F.when(a.isNull() & b.isNull(), None).otherwise(F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
        "count": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
    }
    kept = [F.col(c) for c in rows.columns if c != block]
    each = rows.select("*", *[of[kind](c).over(inside).alias(f"__in_{name}") for name, (kind, c) in values.items()])
    summary = rows.groupBy(key, block).agg(*[of[kind](c).alias(f"__of_{n}") for n, (kind, c) in values.items()])
    before = summary.select(
        F.col(key).alias("__key"),
        F.col(block).alias("__block"),
        *[over[kind](f"__of_{n}").over(earlier).alias(f"__up_{n}") for n, (kind, _) in values.items()],
    )
    joined = each.join(before, F.col(key).eqNullSafe(F.col("__key")) & (F.col(block) == F.col("__block")))
    return joined.select(
        *kept, *[both[kind](F.col(f"__in_{n}"), F.col(f"__up_{n}")).alias(n) for n, (kind, _) in values.items()]
    )
