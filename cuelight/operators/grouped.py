"""Order-dependent work on many small groups, without a pandas frame for each.

Rows are dealt by a hash of the group's key and sorted, so a task gets many whole groups, one after another, and turns
batches of them into tuples at once. A task holds one group at a time beyond its batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def labelled(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    read: Sequence[str],
    work: Callable[[list[tuple]], Sequence[int]],
    name: str,
) -> DataFrame:
    """rows with a long column: what work gives for each row of a group.

    work gets a group's rows, sorted by order, as tuples of the read columns. Keys must not be null.
    """

    def told(pdf: pd.DataFrame) -> pd.DataFrame:
        changes = np.zeros(len(pdf), bool)
        changes[0] = True
        for k in keys:
            own = pdf[k].to_numpy()
            changes[1:] |= own[1:] != own[:-1]
        begins = [*np.flatnonzero(changes).tolist(), len(pdf)]
        tuples = list(zip(*[pdf[c].tolist() for c in read]))
        out = [n for a, b in zip(begins, begins[1:]) for n in work(tuples[a:b])]
        return pdf.assign(**{name: np.array(out, np.int64)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            if not len(pdf):
                continue
            same = np.ones(len(pdf), bool)
            for k in keys:
                same &= (pdf[k] == pdf[k].iloc[-1]).to_numpy()
            # the last group may go on in the next batch
            tail = len(pdf) - int(np.argmin(same[::-1])) if not same.all() else 0
            if tail:
                yield told(pd.concat([*held, pdf.iloc[:tail]], ignore_index=True))
                held = [pdf.iloc[tail:]]
            elif held and any(held[-1][k].iloc[-1] != pdf[k].iloc[0] for k in keys):
                yield told(pd.concat(held, ignore_index=True))
                held = [pdf]
            else:
                held.append(pdf)
        if held:
            yield told(pd.concat(held, ignore_index=True))

    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, *order)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return dealt.mapInPandas(run, f"{fields}, `{name}` long")
