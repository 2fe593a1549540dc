"""Vectors made ready for work in parts of space: usable ones, once each, encoded without loss, and sent to cells.

A vector of decimals, as most stored embeddings are, is encoded as its exponent and 16-bit integers if these give back exactly the same doubles, otherwise as its doubles; so what is shuffled is about a quarter of the table and cosines are still those of the doubles.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.keys import norm_key
from tessera.storage import cut

#: Vectors, about, that cells are made from: a 64th of all, but at least and at most so many.
SAMPLE, MOST_SAMPLED = 8192, 131_072
#: Sampled vectors that a cell is made of at least, so that there are MOST_SAMPLED / this many cells at most; beyond, cells grow and are divided into blocks.
_PER_CELL = 16
_ROUNDS = 6
#: Sampled vectors whose nearest others show how far beyond its own cell a vector must look.
_ASKED = 1024
#: Rows up to which a side that is to be excluded is broadcast.
BROADCAST_ROWS = 50_000
#: Keys of left-out rows (8 bytes each) up to which tasks get them by value, so that no vector is shuffled to leave others out.
LISTED_ROWS = 4_000_000
_RAW = 255
_EXPONENTS = (4, 0, 1, 2, 3, 5, 6)


def encode(x: np.ndarray) -> pa.Array:
    """Binary values of the rows of x (float64), as decode() reads them."""
    n, dim = x.shape
    exponent = np.full(n, _RAW, np.uint8)
    ints = np.zeros((n, dim), np.int16)
    todo = np.arange(n)
    for e in _EXPONENTS:
        if not len(todo):
            break
        y = x[todo]
        whole = np.rint(y * 10.0**e)
        same = (np.abs(whole) <= 32767).all(1) & (whole / 10.0**e == y).all(1)
        exponent[todo[same]], ints[todo[same]] = e, whole[same]
        todo = todo[~same]
    packed = np.empty((n, 1 + 2 * dim), np.uint8)
    packed[:, 0], packed[:, 1:] = exponent, ints.view(np.uint8).reshape(n, 2 * dim)
    lengths = np.where(exponent == _RAW, 1 + 8 * dim, 1 + 2 * dim)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    if len(todo):
        data = b"".join(packed[i].tobytes() if exponent[i] != _RAW else bytes([_RAW]) + x[i].tobytes() for i in range(n))
    else:
        data = packed.tobytes()
    return pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(data)]).cast(pa.binary())


def decode(values: list[bytes], dim: int) -> np.ndarray:
    """The rows that encode() got, as float64."""
    out = np.empty((len(values), dim))
    exponent = np.array([v[0] for v in values], np.uint8)
    for e in np.unique(exponent):
        rows = np.flatnonzero(exponent == e)
        data = b"".join(values[i][1:] for i in rows)
        out[rows] = np.frombuffer(data, np.float64).reshape(-1, dim) if e == _RAW else np.frombuffer(data, np.int16).reshape(-1, dim) / 10.0 ** int(e)
    return out


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dim, rows of the batch, their vectors) of the usable vectors among rows whose embedding has dim elements: no null, NaN or infinite element, not all zero."""
    dims = batch.column("dim").to_numpy(zero_copy_only=False)
    lists = batch.column("embedding")
    for dim in np.unique(dims).tolist():
        rows = np.flatnonzero(dims == dim)
        flat = lists.take(pa.array(rows)).flatten()
        x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
        norm = np.einsum("ij,ij->i", x, x)
        ok = np.isfinite(norm) & (norm > 0)
        if ok.any():
            yield int(dim), rows[ok], x[ok]


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, hashes = batch.column("id"), batch.column("h")
        for dim, rows, x in _by_dim(batch):
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays([ids.take(at), pa.array(np.full(len(rows), dim, np.int32)), hashes.take(at), encode(x)], ["id", "dim", "h", "vec"])


_ENCODED = "id string, dim int, h long, vec binary"


def _shaped(vectors: DataFrame) -> DataFrame:
    rows = vectors.select(norm_key("memory_id").alias("id"), "embedding", F.col("dim").cast("int").alias("dim"))
    rows = rows.where("id is not null and dim > 0 and size(embedding) = dim")
    return rows.withColumn("h", F.xxhash64("embedding"))


@dataclass
class Space:
    """rows: id, dim, h, vec of the vectors to work on, of which a few may be repeated; followers: id and leader of those left out since at least keep equal vectors with smaller ids are in rows; cells: of each dim."""

    rows: DataFrame
    followers: DataFrame | None
    cells: dict[int, Cells]


@dataclass
class Cells:
    """pivots: unit vectors, the centres of cells; margin: by how much the cosine of another pivot may be lower than that of the nearest for a vector's neighbours to be looked for there too; blocks: into how many blocks the rows of each cell are divided; asking: about how many rows look for neighbours in each cell; meet: the margin with which a given share of the pairs share a cell, if asked for."""

    pivots: np.ndarray
    margin: float
    blocks: np.ndarray
    asking: np.ndarray
    meet: float = 0.0


def _homes(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.concatenate([(x[a : a + 4096] @ pivots.T).argmax(1) for a in range(0, len(x), 4096)])


def _around(x: np.ndarray, pivots: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest pivot of each row of x; and rows with other pivots that are within the margin."""
    s = x.astype(np.float32) @ pivots.T
    every, home = np.arange(len(x)), s.argmax(1)
    far = s[every, home] - margin
    s[every, home] = -2
    rows, others = np.nonzero(s >= far[:, None])
    return home, rows, others


def _means(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The pivots, moved to the middle of the rows of x that are nearest to them, some times over."""
    pivots = pivots.copy()
    for _ in range(_ROUNDS):
        home = _homes(x, pivots)
        order = np.argsort(home, kind="stable")
        some, first = np.unique(home[order], return_index=True)
        sums = np.add.reduceat(x[order], first, axis=0)
        length = np.sqrt(np.einsum("ij,ij->i", sums, sums))
        good = length > 1e-6
        pivots[some[good]] = sums[good] / length[good, None]
    return pivots


def _pivots(x: np.ndarray, most: float) -> np.ndarray:
    """Centres of cells for about most rows of x each; a cell that has over half as many again is divided further, as long as its rows differ."""
    limit = max(1, len(x) // _PER_CELL)
    pivots = _means(x, x[: int(min(limit, max(1, round(len(x) / most))))])
    for _ in range(8):
        home = _homes(x, pivots)
        count = np.bincount(home, minlength=len(pivots))
        large = np.flatnonzero(count > max(1.5 * most, 2 * _PER_CELL))[: max(0, limit - len(pivots))]
        if not len(large):
            break
        parts = [np.delete(pivots, large, 0)]
        for c in large:
            own = x[home == c]
            parts.append(_means(own, own[: int(np.ceil(count[c] / most))]))
        pivots = np.concatenate(parts)
    return pivots


def _margin(x: np.ndarray, pivots: np.ndarray, k: int, least: float, share: float, mutual: bool) -> float:
    """The margin with which the cells of a row of x have this share of its k nearest others; of those with a cosine under least, the vectors in their direction with a cosine of least are meant. mutual: it is enough if one of the two has the other's cell."""
    k = min(k, len(x) - 1)
    if k < 1 or len(pivots) < 2:
        return 2.0
    at = np.arange(max(0, len(x) - _ASKED), len(x))
    needs = []
    for a in range(0, len(at), 128):
        me = at[a : a + 128]
        q = x[me]
        s = q @ x.T
        s[np.arange(len(me)), me] = -2
        near = np.argpartition(-s, k - 1, 1)[:, :k]
        c = np.take_along_axis(s, near, 1)[:, :, None]
        v = x[near]
        aside = v - c * q[:, None, :]
        aside /= np.maximum(np.sqrt((aside**2).sum(2, keepdims=True)), 1e-9)
        v = np.where(c < least, least * q[:, None, :] + np.sqrt(max(0.0, 1 - least**2)) * aside, v)
        to, back = q @ pivots.T, v @ pivots.T
        need = to.max(1)[:, None] - np.take_along_axis(to, back.argmax(2), 1)
        if mutual:
            need = np.minimum(need, back.max(2) - back[np.arange(len(me))[:, None], np.arange(k)[None, :], to.argmax(1)[:, None]])
        needs.append(need)
    return float(np.quantile(np.concatenate(needs), share, method="higher")) + 1e-6


def cells_of(sample: np.ndarray, n: int, cell_rows: int, k: int, least: float, share: float, mutual: bool = False, meet: float | None = None) -> Cells:
    """Cells, made from the sample, for n vectors of which about cell_rows share a home; blocks for cells that the sample shows to be larger than twice that; a margin for this share of the k nearest others, or of what has a cosine of least (mutual: if vectors are copied to all cells within the margin). meet: the share for which vectors are to be copied besides; asking then counts these copies."""
    x = unit(sample).astype(np.float32)
    scale = n / len(x)
    pivots = _pivots(x, cell_rows / scale)
    margin = _margin(x, pivots, k, least, share, mutual)
    near = margin if meet is None else _margin(x, pivots, k, least, meet, True)
    stored, asking = np.zeros(len(pivots)), np.zeros(len(pivots))
    for a in range(0, len(x), 1024):
        home, _, others = _around(x[a : a + 1024], pivots, near)
        stored += np.bincount(home, minlength=len(pivots))
        asking += np.bincount(others, minlength=len(pivots))
    blocks = np.maximum(1, np.ceil(stored * scale / (2 * cell_rows))).astype(int)
    return Cells(pivots, margin, blocks, (stored + asking) * scale, near)


def _copies(same: DataFrame, keep: int) -> DataFrame | None:
    """id, h and leader of the vectors of same (id, dim, h) that at least keep equal ones with smaller ids come before; None if there are none."""
    groups = cut(same.groupBy("dim", "h").agg(F.count("*").alias("n")).where(F.col("n") > keep).select("dim", "h"), "groups")
    if groups.isEmpty():
        return None
    rows = cut(same.join(groups, ["dim", "h"]).distinct(), "copies")
    # each partition passes on only its first ids of a group
    rank = F.row_number().over(Window.partitionBy("dim", "h").orderBy("id"))
    firsts = rows.withColumn("rank", rank).where(F.col("rank") <= keep).groupBy("dim", "h").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return cut(rows.join(firsts, ["dim", "h"]).where(~F.array_contains("ids", F.col("id"))).select("id", "h", F.col("ids")[0].alias("leader")), "followers")


def _unlisted(batches: Iterator[pa.RecordBatch], keys: Broadcast) -> Iterator[pa.RecordBatch]:
    left = keys.value
    for batch in batches:
        key = batch.column("key").to_numpy()
        at = np.minimum(np.searchsorted(left, key), len(left) - 1)
        yield batch.filter(pa.array(left[at] != key)).select(["id", "dim", "h", "vec"])


def _without(rows: DataFrame, out: DataFrame) -> DataFrame:
    """rows but for those in out (id, h)."""
    n = out.count()
    if n <= BROADCAST_ROWS:
        return rows.join(F.broadcast(out), ["id", "h"], "left_anti")
    if n > LISTED_ROWS:
        return cut(rows.join(out, ["id", "h"], "left_anti"), "kept")
    keys = np.sort(out.select(F.xxhash64("id", "h").alias("key")).toPandas()["key"].to_numpy())
    keys = rows.sparkSession.sparkContext.broadcast(keys)
    return rows.withColumn("key", F.xxhash64("id", "h")).mapInArrow(partial(_unlisted, keys=keys), _ENCODED)


def prepare(vectors: DataFrame, cell_rows: int, keep: int, k: int, least: float, share: float, ids: DataFrame | None = None, mutual: bool = False, meet: float | None = None) -> Space:
    """The usable vectors of a table (memory_id, embedding, dim), each id once, and cells for them (see :func:`cells_of`).

    Usable: id not null or blank, dim the length of embedding, all elements finite, not all zero. Of an id with several usable vectors the one with the smallest hash counts. ids: an id column; only these take part. Of vectors that are equal at most keep, those with the smallest ids, are worked on, so that no number of copies can fill a cell.
    """
    rows = cut(_shaped(vectors).mapInArrow(_encode, _ENCODED), "vectors")
    brief, out = rows.select("id", "dim", "h"), None
    if ids is not None:
        # keys only; the vectors themselves aren't shuffled for this
        brief = cut(brief.join(ids.distinct().withColumn("known", F.lit(True)), "id", "left"), "brief")
        out = brief.where("known is null").select("id", "h").distinct()
        brief = brief.where("known").select("id", "dim", "h")
    per = {r["dim"]: r["n"] for r in brief.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    several = cut(brief.groupBy("id").agg(F.min("h").alias("least"), F.max("h").alias("most")).where("least <> most").select("id", "least"), "several")
    if not several.isEmpty():
        more = brief.join(several, "id").where("h <> least").select("id", "h").distinct()
        brief = brief.join(more, ["id", "h"], "left_anti")
        out = more if out is None else out.unionByName(more)
    followers = _copies(brief, keep)
    if followers is not None:
        out = followers.select("id", "h") if out is None else out.unionByName(followers.select("id", "h"))
    # the sample is bounded whatever the table; a dim without a sampled row gives its first ones
    n = sum(per.values())
    wanted = min(MOST_SAMPLED, max(SAMPLE, n // 64))
    sampled = rows.where(F.pmod("h", F.lit(max(1, n // wanted))) == 0).dropDuplicates(["dim", "h"]).select("dim", "h", "vec").toPandas()
    if out is not None:
        rows = _without(rows, cut(out, "left_out"))
    cells = {}
    for dim, m in per.items():
        values = sampled[sampled["dim"] == dim].sort_values("h")["vec"].tolist() or [r["vec"] for r in rows.where(F.col("dim") == dim).select("vec").limit(64).collect()]
        cells[dim] = cells_of(decode([bytes(v) for v in values], dim), m, cell_rows, k, least, share, mutual, meet)
    return Space(rows, followers, cells)


def _dims(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims).tolist():
        part = batch.take(pa.array(np.flatnonzero(dims == dim)))
        yield dim, part, unit(decode(part.column("vec").to_pylist(), dim))


def _route(batches: Iterator[pa.RecordBatch], cells: dict[int, tuple]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for dim, part, x in _dims(batch):
            h = part.column("h").to_numpy()
            pivots, margin, blocks, first_task = cells[dim]
            home, others, there = _around(x, pivots, margin)
            at, cell = np.concatenate([np.arange(len(x)), others]), np.concatenate([home, there])
            m = blocks[cell]
            b = (h[at] >> 7) % m
            for k in range(int(m.max(initial=1))):
                some = np.flatnonzero(m > k)
                lo, hi = np.minimum(b[some], k), np.maximum(b[some], k)
                task = first_task[cell[some]] + hi * (hi + 1) // 2 + lo
                take = pa.array(at[some])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(task), dim, np.int32)), pa.array(task.astype(np.int32)), part.column("id").take(take), part.column("vec").take(take)], ["dim", "task", "id", "vec"])


def _first_tasks(tasks: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(tasks)[:-1]])


def route_blocks(c: Cells, cell_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Into how many blocks route() divides what each cell gets, and how many tasks that makes."""
    blocks = np.maximum(1, np.ceil(c.asking / (4 * cell_rows))).astype(int)
    return blocks, blocks * (blocks + 1) // 2


def route(space: Space, cell_rows: int) -> DataFrame:
    """dim, task, id, vec: each row in the tasks of its nearest cell and of all others within the margin (meet, where that is another), so that most tasks have about cell_rows; what one cell gets is divided into blocks, each pair of which is a task. In as many partitions as there are tasks."""
    cells, n = {}, 0
    for dim, c in space.cells.items():
        blocks, tasks = route_blocks(c, cell_rows)
        cells[dim] = (c.pivots, c.meet, blocks, _first_tasks(tasks))
        n += int(tasks.sum())
    return space.rows.mapInArrow(partial(_route, cells=cells), "dim int, task int, id string, vec binary").repartition(max(1, n), "dim", "task")


def _route_home(batches: Iterator[pa.RecordBatch], cells: dict[int, tuple]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for dim, part, x in _dims(batch):
            pivots, blocks, first_task = cells[dim]
            cell = _homes(x.astype(np.float32), pivots)
            task = first_task[cell] + (part.column("h").to_numpy() >> 7) % blocks[cell]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(task), dim, np.int32)), pa.array(task.astype(np.int32)), part.column("id"), part.column("vec")], ["dim", "task", "id", "vec"])


def route_home(space: Space) -> tuple[DataFrame, dict[int, np.ndarray], int]:
    """dim, task, id, vec: each row once, in its block of its nearest cell; of each dim the first task of each cell, whose blocks follow; and the number of tasks."""
    first = {dim: _first_tasks(c.blocks) for dim, c in space.cells.items()}
    cells = {dim: (c.pivots, c.blocks, first[dim]) for dim, c in space.cells.items()}
    n = sum(int(c.blocks.sum()) for c in space.cells.values())
    return space.rows.mapInArrow(partial(_route_home, cells=cells), "dim int, task int, id string, vec binary"), first, n


def _route_asking(batches: Iterator[pa.RecordBatch], cells: dict[int, tuple]) -> Iterator[pa.RecordBatch]:
    names = ["dim", "task", "part", "stored", "asking", "id", "vec"]
    for batch in batches:
        for dim, rows, x in _dims(batch):
            h = rows.column("h").to_numpy()
            pivots, margin, blocks, first_task, parts = cells[dim]
            home, others, there = _around(x, pivots, margin)
            every = np.arange(len(x))
            for at, cell, is_home in ((every, home, True), (others, there, False)):
                block, part = (h[at] >> 7) % blocks[cell], (h[at] >> 17) % parts[cell]
                for b in range(int(blocks[cell].max(initial=1))):
                    for p in range(int(parts[cell].max(initial=1))):
                        stored, asking = (block == b) & is_home, part == p
                        some = np.flatnonzero((blocks[cell] > b) & (parts[cell] > p) & (stored | asking))
                        take = pa.array(at[some])
                        columns = [np.full(len(some), dim, np.int32), (first_task[cell[some]] + b).astype(np.int32), np.full(len(some), p, np.int32), stored[some], asking[some]]
                        yield pa.RecordBatch.from_arrays([*map(pa.array, columns), rows.column("id").take(take), rows.column("vec").take(take)], names)


def route_asking(space: Space, asking_rows: int) -> DataFrame:
    """dim, task, part, stored, asking, id, vec: each row is stored in its nearest cell (in one of the cell's blocks, in all parts of it), and asks in all blocks of that and of all other cells within the margin, in one part of each. There are as many parts as keep those that ask in a task to about asking_rows, and as many partitions as tasks."""
    cells, n = {}, 0
    for dim, c in space.cells.items():
        parts = np.maximum(1, np.ceil(c.asking / asking_rows)).astype(int)
        cells[dim] = (c.pivots, c.margin, c.blocks, _first_tasks(c.blocks), parts)
        n += int((c.blocks * parts).sum())
    rows = space.rows.mapInArrow(partial(_route_asking, cells=cells), "dim int, task int, part int, stored boolean, asking boolean, id string, vec binary")
    return rows.repartition(max(1, n), "dim", "task", "part")
