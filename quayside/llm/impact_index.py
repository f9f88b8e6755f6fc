"""Impact-ordered postings of the vectors of one shard, and an exact search by score at a time.

For each dimension the vectors stand in segments of equal quantised component. A query reads segments in descending order of
the largest absolute product that they can give, and adds each vector's exact products. What a vector has not met yet
is at most the length of its unread part times that of the query's, by Cauchy and Schwarz. The reading stops once all
but a small part of the vectors are proven to be out; the others are scored exactly.
"""

from __future__ import annotations

import numpy as np

#: Quantised levels of a dimension on each side of zero.
LEVELS = 8
#: The stop is looked for so many times while all postings are read.
LOOKS = 16
#: The reading stops when no more than one vector in so many may be among the best.
FEW = 16
#: Sums are doubles, which are exact up to here.
EXACT = 1 << 52
#: Beyond rounding of a product's root.
SLACK = 1 + 1e-12


def build(x: np.ndarray) -> dict[str, np.ndarray]:
    """Flat arrays. x: whole numbers, a row for each vector, rows in ascending order of their ids."""
    x = x.astype(np.int64)
    n, dim = x.shape
    order, values, of_dim, first, last, high = [], [], [], [], [], []
    for d in range(dim):
        v = x[:, d]
        level = v // (max(int(v.max()), -int(v.min())) // LEVELS + 1)
        by = np.argsort(level, kind="stable")
        edges = np.flatnonzero(np.diff(level[by])) + 1
        begins = np.concatenate([[0], edges])
        order.append(by)
        values.append(v[by])
        of_dim.append(np.full(len(begins), d))
        first.append(begins + d * n)
        last.append(np.concatenate([edges, [n]]) + d * n)
        high.append(np.maximum.reduceat(np.abs(v[by]), begins))
    flat = lambda parts, kind=np.int64: np.concatenate([np.zeros(0, kind), *parts]).astype(kind)
    return {"order": flat(order, np.int32), "values": flat(values, x.dtype), "dims": flat(of_dim), "first": flat(first), "last": flat(last), "high": flat(high), "lengths": (x * x).sum(axis=1)}


def _kth(values: np.ndarray, groups: np.ndarray | None, k: int) -> float:
    """The k-th largest; of each group the largest counts alone."""
    if groups is not None:
        values = np.maximum.reduceat(values, groups)
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else -np.inf


def possible(index: dict[str, np.ndarray], x: np.ndarray, q: np.ndarray, k: int, groups: np.ndarray | None) -> tuple[np.ndarray, int]:
    """Positions of all vectors that may be among the k best by inner product with q, and the number of postings read.

    groups: where the vectors of each id begin, if an id has several; the k best are of different ids.
    """
    n = len(x)
    impact = np.abs(q[index["dims"]]) * index["high"]
    order = np.argsort(-impact, kind="stable")
    order = order[: np.count_nonzero(impact)]  # the others add nothing
    if not len(order):
        return np.arange(n), 0
    weight, first, last = q[index["dims"]][order].astype(np.float64), index["first"][order], index["last"][order]
    ends = np.cumsum(last - first)
    stops = np.unique(np.searchsorted(ends, int(ends[-1]) * np.arange(1, LOOKS + 1) // LOOKS, side="left") + 1)
    score, unread = np.zeros(n), index["lengths"].astype(np.float64)
    if not q.all():  # dimensions that the query lacks are never read
        unread -= (x[:, q == 0].astype(np.float64) ** 2).sum(axis=1)
    open_, at = np.full(n, (q.astype(np.float64) ** 2).sum()), 0
    for stop in stops.tolist():
        pieces = [slice(a, b) for a, b in zip(first[at:stop].tolist(), last[at:stop].tolist(), strict=True)]
        rows = np.concatenate([index["order"][p] for p in pieces]).astype(np.int64)
        own = np.concatenate([index["values"][p] for p in pieces]).astype(np.float64)
        by = np.repeat(weight[at:stop], last[at:stop] - first[at:stop])
        score += np.bincount(rows, own * by, minlength=n)
        unread -= np.bincount(rows, own * own, minlength=n)
        open_ -= np.bincount(rows, by * by, minlength=n)
        at = stop
        rest = np.sqrt(unread * open_) * SLACK
        left = np.flatnonzero(score + rest >= _kth(score - rest, groups, k))
        if len(left) * FEW <= n:
            break
    return left, int(ends[at - 1])


def search(index: dict[str, np.ndarray], ids: np.ndarray, x: np.ndarray, query_id: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and exact scores of the k best, best first, ties to the smaller id; without the query's own. ids ascend."""
    groups = None
    if (ids[1:] == ids[:-1]).any():
        groups = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    largest = lambda a: max(int(a.max()), -int(a.min()), 1) if a.size else 0
    bound = len(q) * max(largest(q), largest(x)) ** 2
    # Beyond exact doubles nothing is proven, so all are scored.
    left = possible(index, x, q, k + 1, groups)[0] if bound < EXACT else np.arange(len(ids))
    left = left[ids[left] != query_id]
    if bound < EXACT:
        scores = x[left].astype(np.int64) @ q
    else:
        scores = np.array([sum(int(v) * int(w) for v, w in zip(r, q, strict=True)) for r in x[left]], dtype=object)
        scores = np.array([min(max(int(s), -(1 << 63)), (1 << 63) - 1) for s in scores], dtype=np.int64)
    by = np.lexsort((ids[left], ~scores))
    found, scores = ids[left][by], scores[by]
    if groups is not None:
        once = np.sort(np.unique(found, return_index=True)[1])
        found, scores = found[once], scores[once]
    return found[:k], scores[:k]
