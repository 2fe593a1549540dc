"""A hierarchical navigable small-world graph of one shard, held as flat arrays of neighbours.

A shard is known as a whole, so its layers are built in bulk: the candidates of a vertex are its nearest in the layer, taken from products of blocks of vectors, instead of what a search of a half-built graph finds. The rule for spreading links, links back and the layers are those of the graph built one by one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Neighbours a vertex links to; with those that link to it, it may have twice as many.
LINKS = 12
#: Vertices that a search keeps in view.
BEAM = 40
#: Vertices that a search expands at once.
_WIDTH = 4
_BLOCK = 512
#: Queries whose search advances together, so that what it works on stays in the cache.
_AT_ONCE = 128
#: A layer of at most so many vertices above the lowest is the top.
_TOP = 512
#: Vertices that a layer hands down as a start.
_ENTRIES = 4


def best(s: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """The columns of the m largest values of each row of s and these values, largest first, ties in order of column; s is overwritten."""
    rows = np.arange(len(s))
    m = min(m, s.shape[1])
    at, value = np.empty((len(s), m), np.int32), np.empty((len(s), m), np.float32)
    for i in range(m):
        j = s.argmax(1)
        at[:, i], value[:, i] = j, s[rows, j]
        s[rows, j] = -np.inf
    return at, value


def search(x: np.ndarray, links: np.ndarray, q: np.ndarray, start: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """The beam vertices nearest to each row of q that a best-first search from start (a row of vertices each, -1: none) finds: vertices (-1: none) and similarities, nearest first."""
    parts = [_search(x, links, q[a : a + _AT_ONCE], start[a : a + _AT_ONCE], beam) for a in range(0, len(q), _AT_ONCE)]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _search(x: np.ndarray, links: np.ndarray, q: np.ndarray, start: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    b, n = len(q), len(links)
    seen = np.zeros(b * (n + 1), np.int16)  # by query and vertex; a query's last place takes what isn't there
    seen[n :: n + 1] = 1
    ids = np.full((b, beam), -1, np.int32)
    sims = np.full((b, beam), -np.inf, np.float32)
    done = np.ones((b, beam), bool)
    live = np.arange(b)
    fresh = start
    width = min(_WIDTH, beam)
    while True:
        fresh = np.where(fresh < 0, n, fresh)
        at = live[:, None] * (n + 1) + fresh
        rows, cols = np.nonzero(seen[at] == 0)
        at = at[rows, cols]
        seen[at] = cols + 2
        once = seen[at] == cols + 2  # of a vertex that came twice in a row, the last
        rows, cols = rows[once], cols[once]
        v = fresh[rows, cols]
        new_s = np.full(fresh.shape, -np.inf, np.float32)
        new_s[rows, cols] = np.einsum("ij,ij->i", x[v], q[live[rows]])
        new_i = np.full(fresh.shape, -1, np.int32)
        new_i[rows, cols] = v
        all_s, all_i = np.concatenate([sims[live], new_s], 1), np.concatenate([ids[live], new_i], 1)
        all_d = np.concatenate([done[live], new_i < 0], 1)
        top = np.argpartition(-all_s, beam - 1, 1)[:, :beam]
        s, i, d = (np.take_along_axis(c, top, 1) for c in (all_s, all_i, all_d))
        sims[live], ids[live] = s, i
        open_s = np.where(d, -np.inf, s)
        pick = np.argpartition(-open_s, width - 1, 1)[:, :width]
        good = np.take_along_axis(open_s, pick, 1) > -np.inf
        np.put_along_axis(d, pick, True, 1)
        done[live] = d
        go = good.any(1)
        if not go.any():
            break
        live = live[go]
        expand = np.where(good[go], np.take_along_axis(i[go], pick[go], 1), -1)
        fresh = np.where((expand >= 0)[:, :, None], links[expand], -1).reshape(len(live), -1)
    order = np.argsort(-sims, 1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def _spread(x: np.ndarray, ids: np.ndarray, sims: np.ndarray, links: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row's candidates (nearest first, -1: none) up to links that are nearer to the row's vertex than to one kept before; what is left free goes to the nearest of the others."""
    b, c = ids.shape
    vec = x[ids]
    between = vec @ vec.transpose(0, 2, 1)
    kept = np.zeros((b, c), bool)
    count = np.zeros(b, int)
    closest = np.full((b, c), -np.inf, np.float32)
    for j in range(c):
        ok = (ids[:, j] >= 0) & (count < links) & (sims[:, j] > closest[:, j])
        kept[:, j] = ok
        count += ok
        np.maximum(closest, np.where(ok[:, None], between[:, j], -np.inf), out=closest)
    rank = np.where(kept, 0, np.where(ids >= 0, 1, 2)) * c + np.arange(c)
    order = np.argsort(rank, 1)[:, :links]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


@dataclass
class Layer:
    """vertices: of the shard, in ascending order; x: their vectors; place: of each vertex of the shard in vertices (-1: not there; last: -1); links: flat neighbour array, by place, -1: none; near, near_sims: the candidates each vertex had, nearest first."""

    vertices: np.ndarray
    x: np.ndarray
    place: np.ndarray
    links: np.ndarray
    near: np.ndarray
    near_sims: np.ndarray


class Graph:
    """The graph of the rows of x, unit vectors; a vertex has candidates candidates, of which it links to some."""

    def __init__(self, x: np.ndarray, links: int = LINKS, candidates: int = 2 * LINKS, beam: int = BEAM, seed: int = 0) -> None:
        self.x = np.ascontiguousarray(x, np.float32)
        self.links, self.candidates, self.beam = links, candidates, beam
        n = len(x)
        level = np.minimum(-np.log(np.random.default_rng(seed).random(n)) / np.log(links), 8).astype(int)
        sizes = [int((level >= t).sum()) for t in range(int(level.max(initial=0)) + 1)]
        top = next((t for t, m in enumerate(sizes) if t and m <= _TOP), len(sizes) - 1)
        self.layers = [self._layer(np.flatnonzero(level >= t)) for t in range(top, -1, -1)]

    def _layer(self, vertices: np.ndarray) -> Layer:
        x = self.x[vertices]
        n, most = len(vertices), 2 * self.links
        place = np.full(len(self.x) + 1, -1)
        place[vertices] = np.arange(n)
        m = min(self.candidates, n - 1)
        near, sims = np.empty((n, m), np.int32), np.empty((n, m), np.float32)
        own, own_s = np.empty((n, min(m, self.links)), np.int32), np.empty((n, min(m, self.links)), np.float32)
        for a in range(0, n, _BLOCK):
            some = slice(a, min(n, a + _BLOCK))
            s = x[some] @ x.T
            s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
            near[some], sims[some] = best(s, m)
            own[some], own_s[some] = _spread(x, near[some], sims[some], self.links)
        return Layer(vertices, x, place, self._both_ways(x, own, own_s, most), near, sims)

    def _both_ways(self, x: np.ndarray, own: np.ndarray, own_s: np.ndarray, most: int) -> np.ndarray:
        """The links of own and those back; a vertex that has too many keeps a spread of them."""
        n = len(x)
        out = np.full((n, most), -1, np.int32)
        if not own.size:
            return out
        a, b, s = np.repeat(np.arange(n), own.shape[1]), own.ravel().astype(np.int64), own_s.ravel()
        edge = np.concatenate([a * n + b, b * n + a])
        edge, first = np.unique(edge, return_index=True)
        s = np.concatenate([s, s])[first]
        a, b = edge // n, edge % n
        order = np.lexsort((-s, a))
        a, b, s = a[order], b[order], s[order]
        count = np.bincount(a, minlength=n)
        start = np.cumsum(count) - count
        rank = np.arange(len(a)) - start[a]
        few = count[a] <= most
        out[a[few], rank[few]] = b[few]
        crowded = np.flatnonzero(count > most)
        crowded = crowded[np.argsort(count[crowded], kind="stable")]
        at = 0
        while at < len(crowded):
            # as many at once as keep the products within some megabytes
            width = count[crowded[min(len(crowded) - 1, at + 63)]]
            some = crowded[at : at + max(1, min(64, 4_000_000 // int(width) ** 2))]
            width = int(count[some].max())
            cols = np.arange(width)
            there = cols < count[some, None]
            pick = np.where(there, start[some, None] + cols, 0)
            ids, sims = np.where(there, b[pick], -1), np.where(there, s[pick], -np.inf).astype(np.float32)
            out[some] = _spread(x, ids, sims, most)[0]
            at += len(some)
        return out

    def nearest(self, q: np.ndarray, k: int) -> np.ndarray:
        """For each row of q (unit vectors) the rows of x that a search from the top layer down finds: at least k if there are so many (-1: none), nearest first."""
        top, base = self.layers[0], self.layers[-1]
        beam = max(self.beam, k)
        out = np.full((len(q), beam), -1)
        for a in range(0, len(q), _BLOCK):
            some = np.ascontiguousarray(q[a : a + _BLOCK], np.float32)
            found = top.vertices[best(some @ top.x.T, _ENTRIES)[0]]
            for layer in self.layers[1:-1]:
                ids, _ = search(layer.x, layer.links, some, layer.place[found], _ENTRIES)
                found = np.where(ids >= 0, layer.vertices[ids], -1)
            ids, _ = search(base.x, base.links, some, base.place[found], beam)
            out[a : a + _BLOCK] = np.where(ids >= 0, base.vertices[ids], -1)
        return out
