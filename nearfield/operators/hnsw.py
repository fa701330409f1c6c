"""Layered graph index: built shard by shard, a shard kept as one row, walked for many queries at once."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from nearfield.functions.prng import mulberry32
from nearfield.operators import sweep
from nearfield.operators.knn import matrix, ranked
from nearfield.operators.sweep import BROADCAST_BYTES

M, EF_CONSTRUCTION, EF_SEARCH = 16, 200, 64
SEED = 0x6D2B79F5
MAX_LEVEL = 30
#: What a task holds at once.
SHARD_ROWS = 50_000
#: Candidates that a walk expands in one step.
WIDTH = 8
#: Queries that are walked together.
WALK_ROWS = 128
#: Up to so many queries go to every task; more meet the shards in blocks.
SENT_ROWS = 1024
_FIRST = np.ones(1, bool)
PACKED = "n int, m int, dim int, vectors binary, levels binary, base binary, upper binary"


class Graph:
    """A navigable small-world graph over the rows of a matrix, level by level; distances are smaller for closer.

    Layer 0 is an array of 2m neighbours a row, -1 where there are fewer; the few rows with upper layers have lists. Rows of
    float32 are walked in float32; scores are of doubles."""

    def __init__(self, dimension: int, metric: str = "dot", m: int = M, ef_construction: int = EF_CONSTRUCTION, seed: int = SEED, dtype: type = np.float64):
        self.metric, self.m = metric, max(2, m)
        self.ef_construction = max(self.m, ef_construction)
        self.draw = mulberry32(seed)
        self.x = np.zeros((0, dimension), dtype)
        self.base = np.zeros((0, 2 * self.m), np.int32)
        self.upper: list[list[list[int]]] = []  # by row, by level from 1 on
        self.entry, self.top = -1, -1
        self._stamp, self._now = np.zeros(0, np.int64), 0

    def __len__(self) -> int:
        return len(self.upper)

    def _level(self) -> int:
        return min(int(-math.log(1 - self.draw()) / math.log(self.m)), MAX_LEVEL)

    def distances(self, q: np.ndarray, rows) -> np.ndarray:
        y = self.x[rows]
        return ((y - q) ** 2).sum(1) if self.metric == "l2" else -(y @ q)

    def near(self, row: int, level: int) -> list[int]:
        if level:
            return self.upper[row][level - 1] if level <= len(self.upper[row]) else []
        b = self.base[row]
        return b[b >= 0].tolist()

    def _link(self, row: int, level: int, to: list[int]) -> None:
        if level:
            self.upper[row][level - 1] = to
        else:
            self.base[row] = -1
            self.base[row, : len(to)] = to

    def append(self, vectors: np.ndarray) -> None:
        """Inserts rows one after the other; what was built stays."""
        first, new = len(self), np.asarray(vectors, self.x.dtype)
        self.x = np.concatenate([self.x, new])
        self.base = np.concatenate([self.base, np.full((len(new), 2 * self.m), -1, np.int32)])
        self._stamp = np.concatenate([self._stamp, np.zeros(len(new), np.int64)])
        for row in range(first, len(self.x)):
            self._insert(row)

    def _descend(self, q: np.ndarray, at: int, d: float, high: int, low: int) -> tuple[int, float]:
        for level in range(high, low - 1, -1):
            while near := self.near(at, level):
                ds = self.distances(q, near)
                i = int(ds.argmin())
                if ds[i] >= d:
                    break
                at, d = near[i], float(ds[i])
        return at, d

    def _beam(self, q: np.ndarray, at: np.ndarray, d: np.ndarray, ef: int, level: int) -> tuple[np.ndarray, np.ndarray]:
        """The ef nearest rows that a walk over the level from `at` meets, nearest first."""
        self._now += 1
        stamp, now = self._stamp, self._now
        stamp[at] = now
        order = np.argsort(d, kind="stable")[:ef]
        at, d, done = at[order], d[order], np.zeros(len(order), bool)
        while True:
            todo = np.flatnonzero(~done)[:WIDTH]
            if not len(todo):
                return at, d
            done[todo] = True
            near = self.base[at[todo]].ravel() if level == 0 else np.array([k for r in at[todo].tolist() for k in self.near(r, level)], np.int64)
            near = near[near >= 0]
            near = near[stamp[near] != now]
            if not len(near):
                continue
            near.sort()
            near = near[np.concatenate([_FIRST, near[1:] != near[:-1]])]
            stamp[near] = now
            e = self.distances(q, near)
            if len(at) >= ef:
                better = e < d[-1]
                near, e = near[better], e[better]
            at, d, done = np.concatenate([at, near]), np.concatenate([d, e]), np.concatenate([done, np.zeros(len(near), bool)])
            order = np.argsort(d, kind="stable")[:ef]
            at, d, done = at[order], d[order], done[order]

    def _select(self, at: np.ndarray, d: np.ndarray, most: int) -> np.ndarray:
        """Of candidates by rising distance those that are no closer to one already kept than to the centre."""
        y = self.x[at]
        if self.metric == "l2":
            s = (y**2).sum(1)
            apart = s[:, None] + s[None] - 2 * (y @ y.T)
        else:
            apart = -(y @ y.T)
        apart, limit, kept = apart.tolist(), d.tolist(), []
        for i, row in enumerate(apart):
            if all(row[k] >= limit[i] for k in kept):
                kept.append(i)
                if len(kept) == most:
                    break
        return at[kept]

    def _insert(self, row: int) -> None:
        level, q = self._level(), self.x[row]
        self.upper.append([[] for _ in range(level)])
        if self.entry < 0:
            self.entry, self.top = row, level
            return
        at, d = self._descend(q, self.entry, float(self.distances(q, [self.entry])[0]), self.top, level + 1)
        start, ds = np.array([at]), np.array([d], self.x.dtype)
        for lc in range(min(level, self.top), -1, -1):
            found, ds = self._beam(q, start, ds, self.ef_construction, lc)
            cap = 2 * self.m if lc == 0 else self.m
            chosen = self._select(found[: 4 * self.m], ds[: 4 * self.m], self.m).tolist()
            self._link(row, lc, chosen)
            for i in chosen:
                theirs = [*self.near(i, lc), row]
                if len(theirs) > cap:
                    every = np.array(theirs)
                    e = self.distances(self.x[i], every)
                    order = np.argsort(e, kind="stable")
                    theirs = self._select(every[order], e[order], cap).tolist()
                self._link(i, lc, theirs)
            start, ds = found[:1], ds[:1]
        if level > self.top:
            self.entry, self.top = row, level

    # --- walks for many queries at once

    def _far(self, q: np.ndarray, who: np.ndarray, rows: np.ndarray) -> np.ndarray:
        y = self.x[rows]
        return ((y - q[who]) ** 2).sum(1) if self.metric == "l2" else -np.einsum("ij,ij->i", y, q[who])

    def _enter(self, q: np.ndarray, entry_mode: str) -> tuple[np.ndarray, np.ndarray]:
        """Starting rows of layer 0 and their distances, for each query."""
        n = len(q)
        every = np.arange(n)
        if entry_mode == "spread":
            rows = np.array(list(dict.fromkeys([self.entry, *(i * len(self) // 7 for i in range(7))])))
            at = np.tile(rows, (n, 1))
            return at, np.stack([self._far(q, every, at[:, j]) for j in range(at.shape[1])], 1)
        at = np.full(n, self.entry)
        d = self._far(q, every, at)
        for level in range(self.top, 0, -1):
            moved = every
            while len(moved):
                near = np.full((len(moved), self.m), -1)
                for i, r in enumerate(at[moved].tolist()):
                    some = self.near(r, level)
                    near[i, : len(some)] = some
                who, where = np.nonzero(near >= 0)
                e = np.full(near.shape, np.inf)
                e[who, where] = self._far(q, moved[who], near[who, where])
                best = e.argmin(1)
                least = e[np.arange(len(moved)), best]
                better = least < d[moved]
                moved, least, to = moved[better], least[better], near[np.arange(len(best)), best][better]
                at[moved], d[moved] = to, least
        return at[:, None], d[:, None]

    def _walk(self, q: np.ndarray, ef: int, entry_mode: str) -> tuple[np.ndarray, np.ndarray]:
        """(rows, distances) of each query's ef nearest that a walk meets, nearest first; -1 where there are fewer."""
        n, size = len(q), len(self)
        at, d = self._enter(q, entry_mode)
        seen = np.zeros((n, size), bool)
        seen[np.arange(n)[:, None], at] = True
        pad = ef - at.shape[1]
        order = np.argsort(d, 1, kind="stable")
        at, d = np.take_along_axis(at, order, 1), np.take_along_axis(d, order, 1)
        at, d = np.pad(at, ((0, 0), (0, max(0, pad))), constant_values=-1)[:, :ef], np.pad(d.astype(np.float64), ((0, 0), (0, max(0, pad))), constant_values=np.inf)[:, :ef]
        done = at < 0
        live = np.arange(n)
        while True:
            live = live[~done[live].all(1)]
            if not len(live):
                return at, d
            open_ = ~done[live]
            pick = open_ & (np.cumsum(open_, 1) <= WIDTH // 2)
            who, where = np.nonzero(pick)
            done[live[who], where] = True
            near = self.base[at[live[who], where]]
            key = (who[:, None] * size + near)[near >= 0]
            who, rows = np.divmod(key, size)
            key = key[~seen.ravel()[live[who] * size + rows]]
            if not len(key):
                continue
            key.sort()
            who, rows = np.divmod(key[np.concatenate([_FIRST, key[1:] != key[:-1]])], size)
            seen[live[who], rows] = True
            e = self._far(q, live[who], rows)
            better = e < d[live[who], -1]
            who, rows, e = who[better], rows[better], e[better]
            if not len(who):
                continue
            # new ones beside the old, row by row
            first = np.searchsorted(who, np.arange(len(live) + 1))
            most = int(np.diff(first).max())
            col = ef + np.arange(len(who)) - first[who]
            a, b, c = np.full((len(live), ef + most), -1), np.full((len(live), ef + most), np.inf), np.ones((len(live), ef + most), bool)
            a[:, :ef], b[:, :ef], c[:, :ef] = at[live], d[live], done[live]
            a[who, col], b[who, col], c[who, col] = rows, e, False
            order = np.argsort(b, 1, kind="stable")[:, :ef]
            at[live], d[live], done[live] = np.take_along_axis(a, order, 1), np.take_along_axis(b, order, 1), np.take_along_axis(c, order, 1)

    def search_many(self, q: np.ndarray, k: int, ef: int = EF_SEARCH, entry_mode: str = "descend", may: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, score) of up to k rows for each query, best first. may: which rows can be hits; a walk then looks for more
        than k, twice as many until enough can be or the graph is exhausted."""
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if self.entry < 0 or k <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if max(ef, k) >= len(self):
            state = sweep.Search(k, self.metric, None, lambda q: q).begin(np.asarray(q, np.float64))
            self.exhaust(state, entry_mode, may, np.arange(len(self)))
            who, rows, score = state.result()
            return who, rows, score
        enough = min(k, len(self) if may is None else int(may.sum()))
        for a in range(0, len(q), WALK_ROWS):
            todo, want = np.arange(a, min(a + WALK_ROWS, len(q))), max(ef, k)
            while len(todo):
                part = np.asarray(q[todo], self.x.dtype)
                at, _ = self._walk(part, want, entry_mode)
                good = at >= 0 if may is None else (at >= 0) & may[np.maximum(at, 0)]
                good &= np.cumsum(good, 1) <= k
                ready = np.full(len(todo), True) if may is None or want >= len(self) else good.sum(1) >= enough
                who, where = np.nonzero(good & ready[:, None])
                rows = at[who, where]
                x, y = self.x[rows].astype(np.float64), np.asarray(q[todo], np.float64)[who]
                out.append((todo[who], rows, -((x - y) ** 2).sum(1) if self.metric == "l2" else np.einsum("ij,ij->i", x, y)))
                todo, want = todo[~ready], min(2 * want, len(self))
                if want == len(self) and len(todo):  # the beam would hold them all
                    who, rows, score = self.search_many(q[todo], k, want, entry_mode, may)
                    out.append((todo[who], rows, score))
                    break
        return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

    def _reach(self, start: np.ndarray) -> np.ndarray:
        """Which rows a walk over layer 0 meets from `start` if nothing is left out."""
        seen = np.zeros(len(self), bool)
        seen[start] = True
        at = np.unique(start)
        while len(at):
            near = self.base[at].ravel()
            near = near[near >= 0]
            at = np.unique(near[~seen[near]])
            seen[at] = True
        return seen

    def _reaching(self, row: int) -> np.ndarray:
        """From which rows a walk over layer 0 meets `row`."""
        seen, n = np.zeros(len(self), bool), 0
        seen[row] = True
        while n != (n := int(seen.sum())):
            seen |= (seen[self.base] & (self.base >= 0)).any(1)
        return seen

    def exhaust(self, state: sweep.Begun, entry_mode: str, may: np.ndarray | None, ids: np.ndarray) -> None:
        """Offers what a walk with a beam for all rows meets: all that is reached from where it starts, without walking it query by query."""
        every = np.arange(len(state.q))
        if entry_mode == "spread":
            at, _ = self._enter(np.asarray(state.q[:1], self.x.dtype), entry_mode)
            groups = [(every, self._reach(at[0]))] if len(every) else []
        else:
            whole, home = self._reach(np.array([self.entry])), self._reaching(self.entry)
            if home.all():  # wherever a walk starts, it comes by the entry
                groups = [(every, whole)]
            else:
                at = np.concatenate([np.zeros(0, np.int64), *(self._enter(np.asarray(state.q[a : a + WALK_ROWS], self.x.dtype), entry_mode)[0][:, 0] for a in range(0, len(every), WALK_ROWS))])
                groups = [(every[home[at]], whole), *((every[at == e], self._reach(np.array([e]))) for e in np.unique(at[~home[at]]).tolist())]
        for who, met in groups:
            rows = np.flatnonzero(met if may is None else met & may)
            if len(who) and len(rows):
                state.offer_to(who, ids[rows], self.x[rows].astype(np.float64), None)

    def search(self, q: np.ndarray, k: int, ef: int = EF_SEARCH, entry_mode: str = "descend") -> list[tuple[int, float]]:
        """Up to k (row, score), best first. entry_mode "spread" starts layer 0 from the entry and seven rows evenly
        spread, instead of descending the upper layers."""
        _, rows, score = self.search_many(np.asarray(q, np.float64)[None], k, ef, entry_mode)
        return list(zip(rows.tolist(), score.tolist()))

    # --- what is kept of a graph

    def state(self) -> list[list[list[int]]]:
        return [[self.near(i, level) for level in range(len(up) + 1)] for i, up in enumerate(self.upper)]

    @classmethod
    def restore(cls, x: np.ndarray, links: list[list[list[int]]], metric: str = "dot", m: int = M, ef_construction: int = EF_CONSTRUCTION, seed: int = SEED) -> Graph:
        """The graph from its links, ready to append as if it had never been away: one level is drawn for each row."""
        x = np.asarray(x)
        g = cls(x.shape[1], metric, m, ef_construction, seed, x.dtype.type if x.dtype in (np.float32, np.float64) else np.float64)
        g.x, g.upper = x.astype(g.x.dtype), [[list(l) for l in levels[1:]] for levels in links]
        g.base = np.full((len(x), 2 * g.m), -1, np.int32)
        for row, levels in enumerate(links):
            g.base[row, : len(levels[0])] = levels[0]
        g._resume()
        return g

    def _resume(self) -> None:
        self._stamp = np.zeros(len(self.x), np.int64)
        for row, up in enumerate(self.upper):
            self.draw()
            if len(up) > self.top:
                self.entry, self.top = row, len(up)

    def pack(self) -> dict:
        """The values of PACKED."""
        levels = np.array([len(u) for u in self.upper], np.int32)
        upper = np.full((int(levels.sum()), self.m), -1, np.int32)
        for i, near in enumerate(l for u in self.upper for l in u):
            upper[i, : len(near)] = near
        parts = (self.x, levels, self.base, upper)
        return {"n": len(self), "m": self.m, "dim": self.x.shape[1]} | dict(zip(("vectors", "levels", "base", "upper"), (np.ascontiguousarray(p).tobytes() for p in parts)))

    @classmethod
    def unpack(cls, row: dict, metric: str, ef_construction: int = EF_CONSTRUCTION, seed: int = SEED) -> Graph:
        n, m, dim = row["n"], row["m"], row["dim"]
        dtype = np.float32 if len(row["vectors"]) == 4 * n * dim else np.float64
        g = cls(dim, metric, m, ef_construction, seed, dtype)
        g.x = np.frombuffer(row["vectors"], dtype).reshape(n, dim)
        g.base = np.frombuffer(row["base"], np.int32).reshape(n, 2 * m).copy()
        upper = [[k for k in near if k >= 0] for near in np.frombuffer(row["upper"], np.int32).reshape(-1, m).tolist()]
        i = 0
        for level in np.frombuffer(row["levels"], np.int32).tolist():
            g.upper.append(upper[i : i + level])
            i += level
        g._resume()
        return g


def packed_table(shard: int, ids: pa.Array, g: Graph, id_col: str) -> pa.Table:
    row = g.pack()
    kinds = {"n": pa.int32(), "m": pa.int32(), "dim": pa.int32()}
    return pa.table(
        {"shard": pa.array([shard], pa.int32()), id_col: pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)}
        | {k: pa.array([v], kinds.get(k, pa.binary())) for k, v in row.items()}
    )


def packed_schema(id_col: str, kind: str) -> str:
    return f"shard int, {id_col} array<{kind}>, {PACKED}"


def build(vectors: DataFrame, metric: str = "dot", shards: int = 1, id_col: str = "id", vector_col: str = "vector", m: int = M, ef_construction: int = EF_CONSTRUCTION, seed: int = SEED, first_shard: int = 0) -> DataFrame:
    """(shard, ids, and the columns of PACKED): one graph for each shard of the rows by the hash of their id, rows inserted by id;
    a shard is one row of packed arrays.

    Give as many shards as keep each at SHARD_ROWS or fewer; every shard answers every query, so recall does not fall with
    their number. Shards are numbered from first_shard."""
    kind = vectors.schema[id_col].dataType.simpleString()
    single = vectors.schema[vector_col].dataType.simpleString() == "array<float>"

    def run(key: tuple, table: pa.Table) -> pa.Table:
        x = matrix(table.column(vector_col))
        order = np.argsort(np.asarray(table.column(id_col).to_numpy()), kind="stable")
        g = Graph(x.shape[1], metric, m, ef_construction, seed, np.float32 if single else np.float64)
        g.append(x[order])
        return packed_table(key[0].as_py(), table.column(id_col).combine_chunks().take(pa.array(order)), g, id_col)

    sharded = vectors.select((F.pmod(F.xxhash64(id_col), F.lit(shards)) + first_shard).cast("int").alias("shard"), id_col, vector_col)
    return sharded.groupBy("shard").applyInArrow(run, packed_schema(id_col, kind))


def edges(graph: DataFrame, id_col: str = "id") -> DataFrame:
    """(shard, level, row, neighbours): the graph as an edge table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                links = Graph.unpack(row, "dot").state()
                flat = [(row["shard"], level, pos, near) for pos, levels in enumerate(links) for level, near in enumerate(levels)]
                c = list(zip(*flat)) or [()] * 4
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c[0], pa.int32()), pa.array(c[1], pa.int32()), pa.array(c[2], pa.int32()), pa.array(c[3], pa.list_(pa.int32()))], ["shard", "level", "row", "neighbours"]
                )

    return graph.select("shard", *(x.split(" ")[0] for x in PACKED.split(", "))).mapInArrow(run, "shard int, level int, row int, neighbours array<int>")


def positions(graph: DataFrame, id_col: str = "id") -> DataFrame:
    """(shard, nf_row, id): which row of its shard each id is."""
    return graph.select("shard", F.posexplode(id_col).alias("nf_row", id_col))


def search(
    queries: DataFrame, graph: DataFrame, k: int, ef: int = EF_SEARCH, metric: str = "dot", id_col: str = "id", entry_mode: str = "descend",
    keep: DataFrame | None = None, broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """(q_id, id, score, rank): each shard's graph walked for every query, the k best of all shards. ef is at least k.

    A task reads packed shards, walks the queries together, WALK_ROWS at a time, and keeps the k best of each over its shards; nothing
    else is shuffled. More than SENT_ROWS queries, or than broadcast_bytes, meet the shards in blocks. keep: (id) of the rows
    that may be hits; see Graph.search_many()."""
    kind, q_kind = graph.schema[id_col].dataType.elementType, queries.schema["q_id"].dataType
    schema, id_type = f"q_id {q_kind.simpleString()}, {id_col} {kind.simpleString()}, score double", to_arrow_type(kind)
    columns = ["shard", id_col, *(x.split(" ")[0] for x in PACKED.split(", "))]
    graph = graph.select(*columns)
    if keep is not None:
        some = positions(graph, id_col).join(keep.select(id_col).distinct(), id_col).groupBy("shard").agg(F.collect_list("nf_row").alias("nf_may"))
        graph = graph.join(some, "shard")  # a shard without such a row has no hit
    else:
        graph = graph.withColumn("nf_may", F.lit(None).cast("array<int>"))
    how = sweep.Search(k, "l2" if metric == "l2" else "dot", None, lambda q: q)

    def offer(state: sweep.Begun, cells: list) -> None:
        named = dict(zip([*columns, "nf_may"], cells))
        row = {n: named[n].as_py() for n in ("n", "m", "dim", "levels", "upper")} | {n: named[n].as_buffer() for n in ("vectors", "base")}
        g, ids, may = Graph.unpack(row, metric), sweep.id_array(named[id_col].values), None
        if named["nf_may"].is_valid:
            may = np.zeros(row["n"], bool)
            may[named["nf_may"].values.to_numpy()] = True
        if max(ef, k) >= len(g) > 0 < k:
            return g.exhaust(state, entry_mode, may, ids)
        who, where, score = g.search_many(state.q, k, ef, entry_mode, may)
        order = np.argsort(who, kind="stable")
        state.best.add(who[order], score[order], ids[where[order]])

    rows, size = sweep.side(queries, "q")
    queries = queries.select("q_id", F.col("q").cast("array<double>").alias("q"))
    if rows <= SENT_ROWS and sweep.fits(rows, size, k, broadcast_bytes):
        held = queries.toArrow()
        sent = queries.sparkSession.sparkContext.broadcast((held.column("q_id").combine_chunks(), matrix(held.column("q"))))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q_ids, q = sent.value
            state = how.begin(q)
            for b in batches:
                for i in range(b.num_rows if len(q) else 0):
                    offer(state, [b.column(c)[i] for c in range(b.num_columns)])
            yield sweep.hits_batch(state.result(), q_ids, id_type, id_col)

        return ranked(graph.mapInArrow(run, schema), k, "q_id", id_col)
    per = sweep.query_rows(rows, k, queries.sparkSession.sparkContext.defaultParallelism)
    held_bytes = graph.select(F.sum(F.octet_length("vectors") + F.octet_length("base"))).first()[0] or 0
    parts = -(-held_bytes // sweep.SIDE_BYTES)

    def begin(cells: list) -> tuple:
        q_ids = cells[0].values
        return q_ids.take(pa.array(np.arange(len(q_ids)))), how.begin(sweep.vectors_of(cells[1], len(q_ids), np.float64))

    def end(state: tuple) -> Iterator[pa.RecordBatch]:
        yield sweep.hits_batch(state[1].result(), state[0], id_type, id_col)

    left = sweep.packed(queries, "q_id", ["q"], "l", per)
    return ranked(sweep.meet(left, -(-rows // per), graph, parts, begin, lambda state, cells: offer(state[1], cells), end, schema), k, "q_id", id_col)
