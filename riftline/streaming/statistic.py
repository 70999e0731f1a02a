"""The sliding statistic on an unbounded stream, against frozen cutoffs.

State per series: the next position and the last ``2 w`` samples. A sample at
``t`` gets its statistic once ``w - 1`` samples after it have come; the first
``w`` places are 0 as in the batch operator. The cutoff comes from a batch
calibration, as a quantile over a whole series can't be known in a stream.
Samples of a series must arrive in order from batch to batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

OUT = "series_id string, t long, g double, above boolean"
STATE = "next long, tail array<double>"


def streaming_statistic(stream: DataFrame, w: int, cutoffs: dict[str, float], order: str = "ts", value: str = "x") -> DataFrame:
    """``stream``: series_id (string), ``order``, ``value``. ``cutoffs``: a number for each calibrated series."""

    def step(key, batches, state):
        import numpy as np
        import pandas as pd

        frame = pd.concat(list(batches)).sort_values(order, kind="stable")
        at, tail = state.get if state.exists else (0, [])
        x = np.concatenate([np.asarray(tail, float), frame[value].to_numpy(float)])
        base = at - len(tail)  # position of x[0]
        # places already answered end before at - w + 1
        first = max(0, at - w + 1) if at else 0
        places = np.arange(first, base + len(x) - w + 1)
        g = np.zeros(len(places))
        for k, t in enumerate(places):
            if t >= w:
                i = t - base
                g[k] = round(float(np.sqrt(((np.sort(x[i - w : i]) - np.sort(x[i : i + w])) ** 2).mean())), 9)
        state.update((int(base + len(x)), x[-2 * w :].tolist()))
        cutoff = cutoffs.get(key[0])
        yield pd.DataFrame({"series_id": key[0], "t": places, "g": g, "above": [cutoff is not None and v > cutoff for v in g]})

    return stream.groupBy("series_id").applyInPandasWithState(step, OUT, STATE, "append", "NoTimeout")
