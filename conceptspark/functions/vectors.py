"""Vector column expressions and the block kernel of the similarity search."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: Column) -> Column:
    """Unit vector; a zero vector stays zero."""
    length = norm(a)
    return F.when(length > 0, F.transform(a, lambda x: x / length)).otherwise(a)


def scaled_text(values: Column, digits: int = 6) -> Column:
    """Vector as comma-joined integers of value·10^digits: equal text means equal to that precision."""
    return F.array_join(
        F.transform(values, lambda x: F.round(x * 10.0**digits).cast("long").cast("string")), ","
    )


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 0))


def _found(queries: pd.DataFrame, ids, others, similarities) -> pd.DataFrame:
    """Result rows; the type is a plain object column, whatever string storage pandas chose for it."""
    kind = [queries["type"].iloc[0]] * len(ids) if len(ids) else []
    return pd.DataFrame({"type": pd.Series(kind, dtype=object), "id": ids, "other": others, "similarity": similarities})


def similar_in_block(queries: pd.DataFrame, block: pd.DataFrame, floor: float, best_only: bool) -> pd.DataFrame:
    """Similarities above ``floor`` between query and block rows: each query's best partner, or all with id < other."""
    if not len(queries) or not len(block):
        return _found(queries, [], [], [])
    q_id, b_id = queries["id"].to_numpy(), block["id"].to_numpy()
    sims = np.round(matrix(queries["mean"]) @ matrix(block["mean"]).T, 12)
    if best_only:
        sims[q_id[:, None] == b_id[None, :]] = -np.inf
        top = sims.max(axis=1)
        keep = np.flatnonzero(top > floor)
        # among equal similarities the pair with the smaller ids wins, seen the same way from both sides
        rows = []
        for i in keep:
            ties = b_id[sims[i] == top[i]]
            pair = min((min(q_id[i], o), max(q_id[i], o)) for o in ties)
            rows.append(pair[0] if pair[1] == q_id[i] else pair[1])
        return _found(queries, q_id[keep], rows, top[keep])
    a, b = np.nonzero((sims > floor) & (q_id[:, None] < b_id[None, :]))
    return _found(queries, q_id[a], b_id[b], sims[a, b])


def merge_all(mean: np.ndarray, n: np.ndarray, floor: float) -> np.ndarray:
    """Average linkage of one task's clusters to the end: the row that each row's cluster is called by.

    Rows are in ascending order of their ids. All mutual nearest neighbours above ``floor`` merge in a round under the lower row; among equal
    similarities the pair with the lower rows wins. Only similarities to merged clusters are computed again.
    """
    mean, n = mean.copy(), n.copy()
    name, rows = np.arange(len(mean)), np.arange(len(mean))
    sims = np.round(mean @ mean.T, 12)
    sims[rows, rows] = -np.inf
    top, best = sims.max(1, initial=-np.inf), sims.argmax(1) if len(sims) else rows
    while True:
        # the first column of the highest similarity is the partner whose pair has the lowest rows
        open_ = top > floor
        low = np.flatnonzero(open_ & (best > rows) & (best[best] == rows))
        if not len(low):
            return name
        gone = best[low]
        total = n[low] + n[gone]
        mean[low] = (mean[low] * n[low, None] + mean[gone] * n[gone, None]) / total[:, None]
        n[low] = total
        to = rows.copy()
        to[gone] = low
        name = to[name]
        fresh = np.round(mean[low] @ mean.T, 12)
        fresh[:, np.isneginf(top)] = -np.inf
        fresh[np.arange(len(low)), low] = -np.inf
        sims[low], sims[:, low] = fresh, fresh.T
        both = sims[np.ix_(low, low)]
        sims[np.ix_(low, low)] = np.maximum(both, both.T)  # the same from both sides
        sims[gone], sims[:, gone] = -np.inf, -np.inf
        left = ~open_ & ~np.isneginf(top)  # no partner now, none ever
        sims[left], sims[:, left] = -np.inf, -np.inf
        touched = np.isin(best, np.concatenate([low, gone, np.flatnonzero(left)]))
        touched[low] = touched[gone] = touched[left] = True
        at = np.flatnonzero(touched)
        top[at], best[at] = sims[at].max(1), sims[at].argmax(1)
