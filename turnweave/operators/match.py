"""Speakers of two recordings matched one to one by their voice embeddings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import cosine


def cosine_matrix(a: DataFrame, b: DataFrame, key: str = "meeting") -> DataFrame:
    """key, speaker_a, speaker_b, idx_a, idx_b, similarity of all speaker pairs of a meeting (a handful each)."""
    x = a.select(key, F.col("speaker").alias("speaker_a"), F.col("label_idx").alias("idx_a"), F.col("embedding").alias("ea"))
    y = b.select(key, F.col("speaker").alias("speaker_b"), F.col("label_idx").alias("idx_b"), F.col("embedding").alias("eb"))
    return x.join(y, key).select(key, "speaker_a", "speaker_b", "idx_a", "idx_b", cosine(F.col("ea"), F.col("eb")).alias("similarity"))


def assign(cost: np.ndarray) -> np.ndarray:
    """Column of each row in a least-cost assignment: shortest augmenting paths with row and column prices."""
    n = len(cost)
    row_price, col_price = np.zeros(n + 1), np.zeros(n + 1)
    row_of = np.zeros(n + 1, dtype=int)
    for row in range(1, n + 1):
        row_of[0] = row
        best, prev, used, col = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=int), np.zeros(n + 1, dtype=bool), 0
        while True:
            used[col] = True
            r = row_of[col]
            slack = cost[r - 1] - row_price[r] - col_price[1:]
            better = ~used[1:] & (slack < best[1:])
            best[1:][better], prev[1:][better] = slack[better], col
            free = np.flatnonzero(~used[1:]) + 1
            to = free[np.argmin(best[free])]
            delta = best[to]
            row_price[row_of[used]] += delta
            col_price[used] -= delta
            best[~used] -= delta
            col = to
            if row_of[col] == 0:
                break
        while col:
            row_of[col] = row_of[prev[col]]
            col = prev[col]
    out = np.zeros(n, dtype=int)
    out[row_of[1:] - 1] = np.arange(n)
    return out


def match_speakers(a: DataFrame, b: DataFrame, key: str = "meeting") -> DataFrame:
    """key, speaker_a, speaker_b of greatest total similarity.

    Fails where the numbers of speakers differ or an embedding has no length.
    """
    both = a.select(key, F.lit("a").alias("side"), "label_idx", "speaker", "embedding").unionByName(b.select(key, F.lit("b").alias("side"), "label_idx", "speaker", "embedding"))
    kind = dict(both.dtypes)[key]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = (pdf[pdf.side == s].sort_values("label_idx") for s in "ab")
        if len(x) != len(y):
            raise ValueError(f"speaker counts differ: {len(x)} against {len(y)}; the recordings cannot be matched")
        units = []
        for side in (x, y):
            m = np.array(side.embedding.tolist(), dtype=float)
            size = np.linalg.norm(m, axis=1)
            if (size == 0).any():
                raise ValueError(f"speaker {side.speaker.iloc[int(np.argmin(size))]} has an all-zero embedding")
            units.append(m / size[:, None])
        to = assign(1 - units[0] @ units[1].T)
        return pd.DataFrame({key: x[key].to_numpy(), "speaker_a": x.speaker.to_numpy(), "speaker_b": y.speaker.to_numpy()[to]})

    return both.groupBy(key).applyInPandas(run, f"{key} {kind}, speaker_a string, speaker_b string")


def inverted(matches: DataFrame) -> DataFrame:
    return matches.withColumnsRenamed({"speaker_a": "to_speaker", "speaker_b": "speaker"})
