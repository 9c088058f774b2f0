"""Low-complexity masking by the symmetric DUST score."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WINDOW, LEVEL = 64, 20


def _mask(seq: str, window: int = WINDOW, level: int = LEVEL) -> str:
    """Lower-case every perfect interval of up to ``window`` bases: one whose triplets repeat beyond ``level`` tenths a place,
    and which no interval inside it outscores.

    Intervals grow by one triplet at a time, all starts together: pairs of equal triplets add up, and the best score inside
    an interval is the larger of its own and those of the two intervals that are one shorter.
    """
    s = seq.upper()
    letters = np.frombuffer(s.encode("utf-32-le"), "<u4").astype(np.int64)
    n = len(letters) - 2
    masked = np.zeros(len(letters) + 1, np.int64)
    if n > 1:
        triplet = letters[:-2] << 42 | letters[1:-1] << 21 | letters[2:]
        pairs, best, alike = np.zeros(n, np.int64), np.zeros(n), np.zeros(n, np.int64)
        for length in range(2, min(window - 2, n) + 1):
            # alike[j]: equals of triplet j among the length - 1 before it.
            alike[length - 1 :] += triplet[length - 1 :] == triplet[: n - length + 1]
            starts = n - length + 1
            pairs[:starts] += alike[length - 1 :]
            score = pairs[:starts] / (length - 1)
            inner = np.maximum(best[:starts], best[1 : starts + 1])
            perfect = np.flatnonzero((10 * pairs[:starts] > level * (length - 1)) & (score >= inner))
            best[:starts] = np.maximum(score, inner)
            np.add.at(masked, perfect, 1)
            np.add.at(masked, perfect + length + 2, -1)
    inside = np.cumsum(masked)[:-1] > 0
    return "".join(c.lower() if m else c for c, m in zip(s, inside.tolist(), strict=True))


def dust(seq: Column) -> Column:
    """No built-in expression scores windows of triplets, so this is an Arrow UDF."""

    @F.pandas_udf("string")
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda x: None if x is None else _mask(x))

    return run(seq)
