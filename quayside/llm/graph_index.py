"""A hierarchical navigable small-world graph over the vectors of one shard, as flat neighbour arrays.

Vectors stand in one order; layer l is its first n_l vectors, so a vector on a layer is on every layer below. A layer
is filled from its front in batches: a batch is searched in what is there, linked to diverse near vectors, and linked
back. All searches run for many queries at once.
"""

from __future__ import annotations

import numpy as np

DEGREE = 16  # links that a vector chooses on a layer; twice as many are kept on the lowest one
EF_BUILD, EF_SEARCH = 64, 128
BATCH = 512
TOP = 48  # size from which a layer is not thinned any further


#: Components that are gathered at a time.
GATHERED = 1 << 21


def _near(x: np.ndarray, a: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distances of q[i] to x[a[i, j]]; infinite where a is -1. Some rows at a time, so that memory stays bounded."""
    out = np.empty(a.shape, dtype=x.dtype)
    rows = max(1, GATHERED // max(1, a.shape[1] * x.shape[1]))
    for i in range(0, len(a), rows):
        d = x[a[i : i + rows]] - q[i : i + rows, None, :]
        np.einsum("ijk,ijk->ij", d, d, out=out[i : i + rows])
    out[a < 0] = np.inf
    return out


def _within(x: np.ndarray, new: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """For each vector of a batch the `keep` nearest others of the batch, by a matrix product of the batch, then measured."""
    q = x[new] - x[new].mean(axis=0)
    lengths = np.einsum("ij,ij->i", q, q)
    about = lengths[:, None] + lengths[None, :] - 2 * (q @ q.T)
    np.fill_diagonal(about, np.inf)
    keep = min(keep, len(new))
    near = np.argpartition(about, keep - 1, axis=1)[:, :keep]
    ids = np.where(near == np.arange(len(new))[:, None], -1, new[near])
    return _sorted_candidates(x, ids, x[new])


def beam(x: np.ndarray, links: np.ndarray, q: np.ndarray, entry: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids (-1: none) and squared distances of the ef nearest found for each query, nearest first. entry: [queries, any]."""
    n, width = len(q), max(ef, entry.shape[1])
    ids, dist = np.full((n, width), -1, dtype=np.int64), np.full((n, width), np.inf, dtype=np.float32)
    done = np.ones((n, width), dtype=bool)
    k = entry.shape[1]
    ids[:, :k], dist[:, :k], done[:, :k] = entry, _near(x, entry, q), entry < 0
    seen = np.zeros((n, len(x) + 1), dtype=bool)  # the last column stands for -1
    seen[:, -1] = True
    np.put_along_axis(seen, entry, True, axis=1)
    rows = np.arange(n)
    while True:
        open_ = np.where(done[rows], np.inf, dist[rows])
        at = open_.argmin(axis=1)
        go = np.isfinite(open_[np.arange(len(rows)), at])
        rows, at = rows[go], at[go]
        if not len(rows):
            break
        done[rows, at] = True
        more = links[ids[rows, at]]
        more = np.where(seen[rows[:, None], more], -1, more)
        seen[rows[:, None], more] = True
        d = _near(x, more, q[rows])
        all_d = np.concatenate([dist[rows], d], axis=1)
        keep = np.argpartition(all_d, width - 1, axis=1)[:, :width]
        take = lambda own, new, keep=keep: np.take_along_axis(np.concatenate([own, new], axis=1), keep, axis=1)
        ids[rows], done[rows], dist[rows] = take(ids[rows], more), take(done[rows], more < 0), np.take_along_axis(all_d, keep, axis=1)
    order = np.argsort(dist, axis=1, kind="stable")[:, :ef]
    return np.take_along_axis(ids, order, axis=1), np.take_along_axis(dist, order, axis=1)


def _diverse(x: np.ndarray, ids: np.ndarray, dist: np.ndarray, degree: int) -> np.ndarray:
    """Of each row's candidates, nearest first, those nearer to the row's vector than to any chosen before; then the rest."""
    n = len(ids)
    chosen, count = np.full((n, degree), -1, dtype=np.int64), np.zeros(n, dtype=np.int64)
    used = np.zeros(ids.shape, dtype=bool)
    for strict in (True, False):
        for t in range(ids.shape[1]):
            ok = (ids[:, t] >= 0) & ~used[:, t] & (count < degree)
            if strict and t:
                own = np.flatnonzero(ok)
                ok[own] = _near(x, chosen[own], x[ids[own, t]]).min(axis=1) > dist[own, t]
            own = np.flatnonzero(ok)
            chosen[own, count[own]] = ids[own, t]
            count[own] += 1
            used[own, t] = True
    return chosen


def _sorted_candidates(x: np.ndarray, ids: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = _near(x, ids, q)
    order = np.argsort(d, axis=1, kind="stable")
    return np.take_along_axis(ids, order, axis=1), np.take_along_axis(d, order, axis=1)


def _link_back(x: np.ndarray, links: np.ndarray, new: np.ndarray, chosen: np.ndarray) -> None:
    to, by = chosen.ravel(), np.repeat(new, chosen.shape[1])
    to, by = to[to >= 0], by[to >= 0]
    order = np.argsort(to, kind="stable")
    to, by = to[order], by[order]
    while len(to):
        nodes, first, n = np.unique(to, return_index=True, return_counts=True)
        rank = np.arange(len(to)) - np.repeat(first, n)
        now = rank < DEGREE
        extra = np.full((len(nodes), DEGREE), -1, dtype=np.int64)
        extra[np.repeat(np.arange(len(nodes)), n)[now], rank[now]] = by[now]
        extra[(extra[:, :, None] == links[nodes][:, None, :]).any(axis=2)] = -1  # linked both ways already
        both = np.concatenate([links[nodes], extra], axis=1)
        full = (both >= 0).sum(axis=1) > links.shape[1]
        packed = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), axis=1)
        links[nodes[~full]] = packed[~full, : links.shape[1]]
        if full.any():
            own = nodes[full]
            links[own] = _diverse(x, *_sorted_candidates(x, both[full], x[own]), links.shape[1])
        to, by = to[~now], by[~now]


def build(x: np.ndarray) -> list[np.ndarray]:
    """Neighbour arrays by layer, lowest first. x: float32, rows distinct and in random order."""
    sizes = [len(x)]
    while sizes[-1] > TOP:
        sizes.append(max(sizes[-1] // DEGREE, 1))
    layers: list[np.ndarray] = []  # highest first while they grow
    for size in reversed(sizes):
        lowest = size == len(x)
        own = x[:size]
        links = np.full((size, 2 * DEGREE if lowest else DEGREE), -1, dtype=np.int64)
        at = 0
        while at < size:
            new = np.arange(at, min(size, at + min(BATCH, max(at, 64))))
            q = own[new]
            # Within the batch: all against all, earlier ones and later ones alike.
            ids, dist = _within(own, new, EF_BUILD)
            if at:
                found, d = beam(own, links, q, entries(x, layers, q, at), EF_BUILD)
                order = np.argsort(np.concatenate([d, dist], axis=1), axis=1, kind="stable")[:, :EF_BUILD]
                ids = np.take_along_axis(np.concatenate([found, ids], axis=1), order, axis=1)
                dist = np.take_along_axis(np.concatenate([d, dist], axis=1), order, axis=1)
            ids[~np.isfinite(dist)] = -1
            chosen = _diverse(own, ids, dist, DEGREE)
            links[new, :DEGREE] = chosen
            _link_back(own, links, new, chosen)
            at = new[-1] + 1
        layers.append(links)
    return layers[::-1]


def entries(x: np.ndarray, upper: list[np.ndarray], q: np.ndarray, limit: int) -> np.ndarray:
    """Where to enter a layer, by way of the layers above, highest first in `upper`. Only vectors before `limit`."""
    if not upper:
        return np.broadcast_to(np.arange(min(limit, 8)), (len(q), min(limit, 8))).copy()
    entry = np.broadcast_to(np.arange(len(upper[0])), (len(q), len(upper[0]))).copy()
    for links in upper:
        entry, _ = beam(x[: len(links)], links, q, entry, 8)
    entry[entry >= limit] = 0
    return _once(entry)


def _once(entry: np.ndarray) -> np.ndarray:
    entry = np.sort(entry, axis=1)
    entry[:, 1:][entry[:, 1:] == entry[:, :-1]] = -1
    return entry


def search(x: np.ndarray, layers: list[np.ndarray], q: np.ndarray, k: int, ef: int = EF_SEARCH) -> tuple[np.ndarray, np.ndarray]:
    """Ids (-1: none) and squared distances of the k nearest found for each query."""
    entry = entries(x, layers[:0:-1], q, len(x))
    ids, dist = beam(x, layers[0], q, entry, max(ef, k))
    return ids[:, :k], dist[:, :k]
