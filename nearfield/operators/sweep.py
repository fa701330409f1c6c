"""All-pairs searches in bounded memory: blocks of queries, each against every block of rows in turn, with the best so far kept."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: A query side goes to every task if its vectors and its hits take at most so many bytes; a larger one meets the rows block by block.
BROADCAST_BYTES = 16 << 20
#: Most queries and rows of a block; most cells of a score matrix.
QUERY_ROWS, ROWS, CELLS = 2048, 4096, 1 << 21
#: Bytes of packed rows that a task goes through for each block of queries.
SIDE_BYTES = 64 << 20
#: What a matrix product and a sum of one pair's products may differ by, in parts of the lengths' product.
SLACK = 1e-12
_LEAST = np.finfo(np.float64).min


def numbers(ids: np.ndarray) -> np.ndarray:
    """Numbers in the order of the ids, nulls first."""
    if ids.dtype != object:
        return ids
    out, have = np.full(len(ids), -1), np.array([i is not None for i in ids.tolist()], bool)
    out[have] = np.unique(np.array(ids[have].tolist()), return_inverse=True)[1]
    return out


class Best:
    """The k best rows of each of n queries among what was offered so far; ties go to the smaller id, NaN is never among them.

    A block of scores costs one comparison a pair: only what reaches a query's k-th best is looked at. extra: a second number
    that is kept with each row."""

    def __init__(self, n: int, k: int, extra: bool = False):
        self.n, self.k, self.extra = n, k, extra
        self.least = np.full(n, _LEAST)
        self.held: list[np.ndarray] | None = None
        self.fresh: list[tuple[np.ndarray, ...]] = []
        self.pending = np.zeros(n, np.int64)

    def candidates(self, s: np.ndarray, rows: np.ndarray | slice = slice(None), slack: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """(row of s, column) of the scores that may be among the k best. rows: which queries the rows of s are."""
        least, n = self.least[rows] - slack, s.shape[1]
        may = s >= least[:, None]
        if n > self.k and np.count_nonzero(may) > 4 * self.k * len(s):
            t = np.where(np.isnan(s), -np.inf, s)
            may = s >= np.maximum(least, np.partition(t, n - self.k, axis=1)[:, n - self.k] - slack)[:, None]
        return np.divmod(np.flatnonzero(may), n)

    def add(self, who: np.ndarray, *parts: np.ndarray) -> None:
        """Scores, ids and extras of rows for queries, by rising query."""
        if not len(who):
            return
        self.fresh.append((who, *parts))
        self.pending += np.bincount(who, minlength=self.n)
        # before a few queries get much more than the others: they would make the matrix of all wide
        if self.pending.sum() > max(self.n * self.k, 1 << 16) or self.pending.max() > max(4 * self.k, 256):
            self.settle()

    def settle(self) -> None:
        """Cuts what is held and what was added to k for each query that got any."""
        if not self.fresh:
            return
        if self.held is None:
            self.held = [np.full((self.n, self.k), -np.inf), *(np.zeros((self.n, self.k), p.dtype) for p in self.fresh[0][2:])]
        some = np.flatnonzero(self.pending)
        place = np.zeros(self.n, np.int64)
        place[some] = np.arange(len(some))
        pads = np.full((len(some), int(self.pending.max())), -np.inf)
        wide = [np.concatenate([h[some], (pads if i == 0 else np.zeros(pads.shape, h.dtype))], 1) for i, h in enumerate(self.held)]
        at = np.full(len(some), self.k)
        for who, *parts in self.fresh:
            row = place[who]
            each = np.bincount(row, minlength=len(some))
            col = at[row] + np.arange(len(row)) - (np.cumsum(each) - each)[row]
            for w, p in zip(wide, parts):
                w[row, col] = p
            at += each
        self.fresh, self.pending[:] = [], 0
        s = wide[0]
        cut = np.argpartition(s, s.shape[1] - self.k, axis=1)[:, s.shape[1] - self.k :]
        kept = np.take_along_axis(s, cut, 1)
        kth = kept.min(1)
        tied = ((s == kth[:, None]).sum(1) > (kept == kth[:, None]).sum(1)) & (kth >= _LEAST)
        for r in np.flatnonzero(tied).tolist():  # which of equals stay is up to the id
            real = np.flatnonzero(s[r] >= kth[r])
            cut[r] = real[np.lexsort((numbers(wide[1][r][real]), -s[r][real]))[: self.k]]
        for h, w in zip(self.held, wide):
            h[some] = np.take_along_axis(w, cut, 1)
        self.least[some] = np.maximum(kth, _LEAST)

    def result(self, k: int | None = None, by: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score): by 0 the k best, best first; by 2 those of the k that have the best extra number, with that as score."""
        self.settle()
        if self.held is None:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        who, col = np.nonzero(self.held[0] >= _LEAST)
        score, ids = self.held[by][who, col], self.held[1][who, col]
        order = np.lexsort((numbers(ids), -score, who))
        who, ids, score = who[order], ids[order], score[order]
        keep = np.arange(len(who)) - np.searchsorted(who, np.arange(self.n))[who] < (k or self.k)
        return who[keep], ids[keep], score[keep]


class Search:
    """What a search computes of a block of queries and a block of rows; sent to the tasks.

    seen(columns, n): the n rows as a matrix; asked(q): the queries as they are multiplied with it. With exact(columns, n) the k * factor
    best by these products are ranked by their true scores. own(columns, n): each row's cluster, of which a query looks into
    those of probes(q), (query, cluster). pair(q, x): the scores row by row, if they are no products but within `apart` of them; blocks
    are then multiplied in float32, and rows that share no coordinate with a query aren't scored."""

    def __init__(
        self, k: int, metric: str, seen: Callable, asked: Callable, exact: Callable | None = None, factor: int = 1, own: Callable | None = None, probes: Callable | None = None,
        pair: Callable | None = None, apart: float = 0.0,
    ):
        self.k, self.metric, self.seen, self.asked, self.exact, self.factor, self.own, self.probes = k, metric, seen, asked, exact, factor, own, probes
        self.pair, self.apart = pair, apart

    def begin(self, q: np.ndarray) -> Begun:
        return Begun(self, q)


def pair_scores(metric: str, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Scores row by row: equal rows have equal scores, wherever they lie."""
    return -((q - x) ** 2).sum(1) if metric == "l2" else np.einsum("ij,ij->i", q, x)


class Begun:
    def __init__(self, search: Search, q: np.ndarray):
        self.search, self.q, self.asked = search, q, search.asked(q)
        self.best = Best(len(q), search.k * (search.factor if search.exact else 1), search.exact is not None)
        self.long = float(np.sqrt((self.asked**2).sum(1).max(initial=0)))
        self.by = {}
        if search.probes is not None:
            who, cluster = search.probes(q)
            order = np.argsort(cluster, kind="stable")
            who, cluster = who[order], cluster[order]
            names, first = np.unique(cluster, return_index=True)
            self.by = dict(zip(names.tolist(), np.split(who, first[1:])))

    def offer(self, ids: np.ndarray, columns: list) -> None:
        s, n = self.search, len(ids)
        if not n or not len(self.q):
            return
        if s.own is None:
            return self.offer_to(np.arange(len(self.q)), ids, s.seen(columns, n), None if s.exact is None else s.exact(columns, n))
        cluster = s.own(columns, n)
        names = [c for c in np.unique(cluster).tolist() if c in self.by]
        if names:
            x, true = s.seen(columns, n), None if s.exact is None else s.exact(columns, n)
        for c in names:
            rows = np.flatnonzero(cluster == c)
            rows = slice(rows[0], rows[-1] + 1) if rows[-1] - rows[0] + 1 == len(rows) else rows
            self.offer_to(np.sort(self.by[c]), ids[rows], x[rows], None if true is None else true[rows])

    def offer_to(self, mine: np.ndarray, ids: np.ndarray, x: np.ndarray, true: np.ndarray | None) -> None:
        s, metric = self.search, "dot" if true is not None else self.search.metric
        step, square = max(1, CELLS // len(ids)), np.einsum("ij,ij->i", x, x)
        slack = SLACK * (1 + (self.long + np.sqrt(np.nan_to_num(square).max())) ** 2)
        pair = s.pair or (lambda y, x: pair_scores(metric, y, x))
        if s.pair is not None:
            coarse, slack = x.astype(np.float32), s.apart
        for a in range(0, len(mine), step):
            part = mine[a : a + step]
            y = self.asked[part]
            if s.pair is None:
                scores = y @ x.T
            else:
                scores = y.astype(np.float32) @ coarse.T
                none = scores == 0
                if len(cols := np.flatnonzero(none.any(0))):
                    met = (y != 0).astype(np.float32) @ (coarse[cols] != 0).astype(np.float32).T
                    scores[:, cols] = np.where(met == 0, -np.inf, scores[:, cols])
            if metric == "l2":
                scores *= 2
                scores -= np.einsum("ij,ij->i", y, y)[:, None]
                scores -= square
            i, j = self.best.candidates(scores, part, slack)
            for b in range(0, len(i), CELLS // 64):
                k, m = i[b : b + CELLS // 64], j[b : b + CELLS // 64]
                own = () if true is None else (pair_scores(s.metric, self.q[part[k]], true[m]),)
                self.best.add(part[k], pair(y[k], x[m]), ids[m], *own)

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.best.result(self.search.k, 2 if self.search.exact is not None else 0)


def id_array(ids: pa.Array) -> np.ndarray:
    return np.array(ids.to_pylist(), object) if ids.null_count else np.asarray(ids.to_numpy(zero_copy_only=False))


def raw(column: pa.Array) -> bytes:
    """Numbers, lists of them or byte strings, end to end."""
    if pa.types.is_list(column.type):
        flat = column.flatten()
        if column.null_count or flat.null_count or len(flat) % max(1, len(column)) or len(set(column.value_lengths().unique().to_pylist())) > 1:
            raise ValueError("vectors must be of one dimension, without nulls")
        return np.ascontiguousarray(flat.to_numpy(zero_copy_only=False)).tobytes()
    if pa.types.is_binary(column.type):
        return b"".join(column.to_pylist())
    return np.ascontiguousarray(column.to_numpy(zero_copy_only=False)).tobytes()


def packed(df: DataFrame, id_col: str, columns: list[str], name: str, rows: int, sort: str | None = None) -> DataFrame:
    """(<name>_ids, <name>_<column> BINARY): rows packed by up to so many; sort: a column by which the rows of a block are sorted."""
    kind = df.schema[id_col].dataType.simpleString()
    out = [f"{name}_ids", *(f"{name}_{c}" for c in columns)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(t: pa.Table) -> pa.RecordBatch:
            if sort is not None:
                t = t.take(pa.array(np.argsort(np.asarray(t.column(1 + columns.index(sort))), kind="stable")))
            t = t.combine_chunks()
            cells = [t.column(i).combine_chunks() if isinstance(t.column(i), pa.ChunkedArray) else t.column(i) for i in range(t.num_columns)]
            ids = pa.ListArray.from_arrays(pa.array([0, t.num_rows], pa.int32()), cells[0])
            return pa.RecordBatch.from_arrays([ids, *(pa.array([raw(c)], pa.binary()) for c in cells[1:])], out)

        wait, n = [], 0
        for b in batches:
            wait, n = [*wait, b], n + b.num_rows
            if n >= rows:
                t = pa.Table.from_batches(wait)
                for a in range(0, n - n % rows, rows):
                    yield block(t.slice(a, rows))
                wait, n = t.slice(n - n % rows).to_batches(), n % rows
        if n:
            yield block(pa.Table.from_batches(wait))

    return df.select(id_col, *columns).mapInArrow(run, ", ".join([f"{name}_ids array<{kind}>", *(f"{o} binary" for o in out[1:])]))


def side(df: DataFrame, vector_col: str) -> tuple[int, int]:
    """(rows, bytes of their vectors as doubles), by counting."""
    n, size = df.agg(F.count("*"), F.sum(F.size(vector_col).cast("long") * 8)).first()
    return int(n), int(size or 0)


def fits(rows: int, size: int, k: int, broadcast_bytes: int) -> bool:
    """Whether queries, and what each task keeps for them, are few enough to go to every task."""
    return size + 24 * rows * k <= broadcast_bytes


def query_rows(rows: int, k: int, tasks: int) -> int:
    """How many queries a block has: fewer if each keeps many hits, or if there would be too few blocks for the cores."""
    return max(64, min(QUERY_ROWS, (1 << 20) // max(1, k), -(-rows // (2 * tasks))))


def meet(left: DataFrame, blocks: int, right: DataFrame, parts: int, begin: Callable, offer: Callable, end: Callable, schema: str) -> DataFrame:
    """Each row of left with every row of right, in as many runs of right's rows as parts: begin(left cells), then offer(state, right
    cells), then the batches of end(state). Neither side has to fit anywhere: right is shuffled once, and read again for each row of left.

    A task has about one row of left: Spark puts 10,000 pairs into an Arrow batch whatever their bytes, so the pairs of a task are one."""
    n, blocks = len(left.columns), max(1, blocks)
    spread = F.monotonically_increasing_id()  # the partition, and from bit 33 down the place in it
    at = F.shiftrightunsigned(spread, 33) + spread.bitwiseAND(F.lit((1 << 33) - 1)) * left.sparkSession.sparkContext.defaultParallelism
    left = left.withColumn("nf_block", F.monotonically_increasing_id()).repartitionById(blocks, F.pmod(at, F.lit(blocks)).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, of = None, None
        for b in batches:
            names = b.column(n).to_pylist()
            for i in range(b.num_rows):
                if names[i] != of:  # left rows come one after the other, each with all right rows
                    if of is not None:
                        yield from end(state)
                    state, of = begin([b.column(c)[i] for c in range(n)]), names[i]
                offer(state, [b.column(c)[i] for c in range(n + 1, b.num_columns)])
        if of is not None:
            yield from end(state)

    pairs = left.crossJoin(right.repartition(max(1, parts)).hint("shuffle_replicate_nl"))
    return pairs.mapInArrow(run, schema)


def vectors_of(cell: Any, rows: int, kind: type) -> np.ndarray:
    return np.frombuffer(cell.as_buffer(), kind).reshape(rows, -1).astype(np.float64)


def hits_batch(found: tuple[np.ndarray, np.ndarray, np.ndarray], q_ids: pa.Array, id_type: pa.DataType, id_col: str) -> pa.RecordBatch:
    who, ids, score = found
    return pa.RecordBatch.from_arrays([q_ids.take(pa.array(who)), pa.array(ids.tolist() if ids.dtype == object or not len(ids) else ids, id_type), pa.array(score)], ["q_id", id_col, "score"])


def run_search(
    queries: DataFrame, corpus: DataFrame, search: Search, id_col: str, columns: list[str], broadcast_bytes: int, sort: str | None = None,
    prune: Callable[[DataFrame, np.ndarray], DataFrame] | None = None, most: int | None = None,
) -> DataFrame:
    """(q_id, id, score): for each row (q_id, q) of queries at least the k best of corpus; several tasks may each have found k.

    Search's functions get the columns as Arrow arrays or, of a block, as bytes. prune(corpus, q): what of the corpus the broadcast
    queries need. most: rows of the corpus at most, if known without reading it."""
    kind, q_kind = corpus.schema[id_col].dataType, queries.schema["q_id"].dataType
    schema = f"q_id {q_kind.simpleString()}, {id_col} {kind.simpleString()}, score double"
    id_type = to_arrow_type(kind)
    keep = search.k * (search.factor if search.exact is not None else 1)
    rows, size = side(queries, "q")
    queries = queries.select("q_id", F.col("q").cast("array<double>").alias("q"))
    if fits(rows, size, keep, broadcast_bytes) and search.exact is None:
        held = queries.toArrow()
        q = np.frombuffer(raw(held.column("q").combine_chunks()), np.float64).reshape(rows, -1) if rows else np.zeros((0, 0))
        sent = corpus.sparkSession.sparkContext.broadcast((held.column("q_id").combine_chunks(), q))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q_ids, q = sent.value
            state = search.begin(q) if len(q) else None
            for b in batches:
                for a in range(0, b.num_rows if state else 0, ROWS):
                    part = b.slice(a, ROWS)
                    state.offer(id_array(part.column(0)), part.columns[1:])
            if state:
                yield hits_batch(state.result(), q_ids, id_type, id_col)

        some = prune(corpus, q) if prune is not None and rows else corpus
        return some.select(id_col, *columns).mapInArrow(run, schema)
    tasks = queries.sparkSession.sparkContext.defaultParallelism
    per = query_rows(rows, keep, tasks)
    # what is ranked anew has to meet all rows in one task
    parts = 1 if search.exact is not None else -(-(corpus.count() if most is None else most) * (size // max(1, rows) + 16) // SIDE_BYTES)
    left = packed(queries, "q_id", ["q"], "l", per)
    right = packed(corpus, id_col, columns, "r", ROWS if search.exact is None else ROWS // 4, sort)

    def begin(cells: list) -> tuple:
        q_ids = cells[0].values
        return q_ids.take(pa.array(np.arange(len(q_ids)))), search.begin(vectors_of(cells[1], len(q_ids), np.float64))

    def end(state: tuple) -> Iterator[pa.RecordBatch]:
        yield hits_batch(state[1].result(), state[0], id_type, id_col)

    return meet(left, -(-rows // per), right, parts, begin, lambda state, cells: state[1].offer(id_array(cells[0].values), cells[1:]), end, schema)


def numbers_of(cell: Any, kind: type) -> np.ndarray:
    """A column of numbers, of a batch or as bytes of a block."""
    return np.frombuffer(cell.as_buffer(), kind) if isinstance(cell, pa.Scalar) else np.asarray(cell).astype(kind, copy=False)


def vectors_at(at: int, df: DataFrame, vector_col: str) -> Callable[[list, int], np.ndarray]:
    """For Search: the column of that place among columns, of df's vectors, as rows of doubles."""
    from nearfield.operators.knn import matrix

    kind = np.float32 if df.schema[vector_col].dataType.simpleString() == "array<float>" else np.float64
    return lambda columns, n: vectors_of(columns[at], n, kind) if isinstance(columns[at], pa.Scalar) else matrix(columns[at])
