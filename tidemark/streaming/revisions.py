"""Figures as a stream: each revision of a (company, year, metric) as it is published.

The batch operators see all reports at once; here a figure's last published
value is state, and a newer report with another value emits an event.  Of a
figure's rows within a micro-batch, however many Arrow batches they come in,
the last of each publish year (by ord) counts, and publish years are handled in
order; a report that comes after a newer one was seen changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "company string, year int, metric string, old double, new double, pct double, old_pub int, new_pub int"
STATE = "value double, pub int"


def revisions(figures: DataFrame, noise_floor_pct: float = 0.5) -> DataFrame:
    """Events of a streaming table with company, year, metric, value, pub and, maybe, ord (without it, the greatest value of a publish year counts).  A small state row for each figure; what is held of a micro-batch is a value for each publish year."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        value, pub = state.get if state.exists else (None, None)
        latest: dict[int, tuple] = {}
        for batch in batches:
            for v, p, o in zip(batch["value"].tolist(), batch["pub"].tolist(), batch["ord"].tolist(), strict=True):
                if p not in latest or (o, v) > latest[p]:
                    latest[p] = (o, v)
        out = []
        for p in sorted(latest):
            v = latest[p][1]
            if pub is not None and p <= pub:
                continue
            if value is not None and v != value:
                pct = (v - value) / abs(value) * 100 if value else None
                if pct is None or abs(pct) >= noise_floor_pct:
                    out.append((*key, value, v, pct, int(pub), int(p)))
            value, pub = v, p
        if value is not None:
            state.update((float(value), int(pub)))
        yield pd.DataFrame(out, columns=["company", "year", "metric", "old", "new", "pct", "old_pub", "new_pub"])

    if "ord" not in figures.columns:
        figures = figures.withColumn("ord", F.lit(0).cast("long"))
    return figures.where("pub is not null and value is not null").groupBy("company", "year", "metric").applyInPandasWithState(step, EVENTS, STATE, "append", GroupStateTimeout.NoTimeout)
