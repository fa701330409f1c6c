"""SimHash near-dedup with an inverted index of fingerprint bytes by position."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfield.llm.components import connected_components
from nearfield.llm.textscan import WORD, groups_of_rows, materialize, string_spans, words_of

BYTES = 16  # a fingerprint has 128 bits
MAX_DISTANCE = 20
#: Equal bytes, position by position, that near fingerprints have in one half at least. Up to 11 differing bits can spoil 11
#: of the 16 bytes at most, which leaves 5, so 3 in one half: within 11 bits this minimum is guaranteed.
MIN_SHARED = 3
_CHUNK = 1 << 19
#: The index's postings: any three positions within the first or the second half.
TRIPLES = np.array([t for half in (range(8), range(8, 16)) for t in combinations(half, 3)], np.int64)
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprints(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints as rows of 16 bytes, distinct words of each row). A bit is set if more than half of the
    distinct words' hashes have it."""
    n = len(starts)
    out, words = np.zeros((n, BYTES), np.uint8), np.zeros(n, np.int64)
    for lo, hi in groups_of_rows(starts, ends, _CHUNK):
        row, _, _, h = words_of(raw, starts[lo:hi], ends[lo:hi], WORD)
        order = np.lexsort((h, row))
        row, h = row[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
        row, h = row[new], h[new]
        m = hi - lo
        count = np.bincount(row, minlength=m)
        words[lo:hi] = count
        with np.errstate(over="ignore"):
            second = (h ^ np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0xFF51AFD7ED558CCD)
            second ^= second >> np.uint64(32)
        both = np.stack([h, second], 1).view(np.uint8).reshape(-1, BYTES)
        for k in range(BYTES):
            # how many words of a row have each value of the byte, then how often each bit is set
            table = np.bincount(row * 256 + both[:, k], minlength=m * 256).reshape(m, 256)
            out[lo:hi, k] = np.packbits(table @ _BITS * 2 > count[:, None], axis=1)[:, 0]
    return out, words


def fingerprint_table(docs: DataFrame) -> DataFrame:
    """(doc_id, hi, lo) of the rows with a doc_id and at least one word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f, words = fingerprints(*string_spans(b.column(1)))
            ok = words > 0
            two = np.ascontiguousarray(f).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).filter(pa.array(ok)), pa.array(two[ok, 0]), pa.array(two[ok, 1])], ["doc_id", "hi", "lo"]
            )

    rows = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    return rows.select(rows["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, hi long, lo long")


def postings(distinct: DataFrame) -> DataFrame:
    """(key, hi, lo, node): each fingerprint under each of its byte triples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hi, lo, node = (np.asarray(b.column(i)) for i in range(3))
            for a in range(0, len(hi), 4096):
                h, o, d = hi[a : a + 4096], lo[a : a + 4096], node[a : a + 4096]
                byte = np.ascontiguousarray(np.stack([h, o], 1)).view(np.uint8).reshape(-1, BYTES).astype(np.int64)
                t = byte[:, TRIPLES]
                key = (np.arange(len(TRIPLES)) << 24) | (t[:, :, 0] << 16) | (t[:, :, 1] << 8) | t[:, :, 2]
                k = len(TRIPLES)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.ravel()), *(pa.array(np.repeat(x, k)) for x in (h, o, d))], ["key", "hi", "lo", "node"]
                )

    return distinct.select("hi", "lo", "node").mapInArrow(run, "key long, hi long, lo long, node long")


def near(a: np.ndarray, b: np.ndarray, distance: int = MAX_DISTANCE, shared: int = MIN_SHARED) -> np.ndarray:
    """Whether fingerprints, rows of two 64-bit words, are near: the count filter (`shared` equal bytes by position in one half),
    then the Hamming distance."""
    x = a ^ b
    equal = (np.ascontiguousarray(x).view(np.uint8).reshape(-1, 2, BYTES // 2) == 0).sum(2).max(1)
    ok = equal >= shared
    ok[ok] = np.bitwise_count(x[ok].view(np.uint64)).sum(1) <= distance
    return ok


def bucket_edges(key: np.ndarray, f: np.ndarray, node: np.ndarray, distance: int, shared: int, small: int = 48) -> np.ndarray:
    """Edges that connect what is near within each bucket of equal keys (sorted): pairs of nodes, as rows.

    Small buckets: every pair. Larger ones: a search from node to node over the not yet reached, each compared with
    all of them at once, so that every member that any chain of near pairs reaches is joined; no pair is capped away,
    and a bucket of near copies costs a few passes instead of all pairs."""
    edges = [np.zeros((0, 2), np.int64)]
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.r_[start, len(key)])
    of = np.repeat(size, size)
    for gap in range(1, small):
        i = np.flatnonzero((of[:-gap] <= small) & (key[:-gap] == key[gap:])) if len(key) > gap else np.zeros(0, np.int64)
        if not len(i):
            break
        for part in np.array_split(i, 1 + len(i) // 500_000):
            ok = near(f[part], f[part + gap], distance, shared)
            edges.append(np.stack([node[part[ok]], node[part[ok] + gap]], 1))
    for s, n in zip(start[size > small].tolist(), size[size > small].tolist()):
        g, d = f[s : s + n], node[s : s + n]
        left = np.arange(n)
        queue: list[int] = []
        while len(left):
            if queue:
                at = queue.pop()
            else:
                at, left = int(left[0]), left[1:]
            if not len(left):
                break
            close = near(np.broadcast_to(g[at], (len(left), 2)), g[left], distance, shared)
            hit = left[close]
            if len(hit):
                edges.append(np.stack([np.full(len(hit), d[at]), d[hit]], 1))
                queue += hit.tolist()
                left = left[~close]
    return np.concatenate(edges)


def near_pairs(index: DataFrame, distance: int = MAX_DISTANCE, shared: int = MIN_SHARED) -> DataFrame:
    """(a, b), a < b: edges whose connected components are those of all near pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        seen = np.zeros((0, 2), np.int64)

        def flush(key, f, node):
            nonlocal seen
            e = np.sort(bucket_edges(key, f, node, distance, shared), axis=1)
            seen = forest(np.concatenate([seen, e]))

        for b in batches:
            key, hi, lo, node = (np.asarray(b.column(i)) for i in range(4))
            if not len(key):
                continue
            held.append((key, np.stack([hi, lo], 1), node))
            last = key[-1]
            if held[0][0][0] == last:
                continue  # one bucket so far
            k, f, d = (np.concatenate(x) for x in zip(*held))
            cut = int(np.searchsorted(k, last))
            flush(k[:cut], f[:cut], d[:cut])
            held = [(k[cut:], f[cut:], d[cut:])]
        if held:
            flush(*(np.concatenate(x) for x in zip(*held)))
        yield pa.RecordBatch.from_arrays([pa.array(seen[:, 0]), pa.array(seen[:, 1])], ["a", "b"])

    placed = index.repartition("key").sortWithinPartitions("key")
    return placed.mapInArrow(run, "a long, b long")


def forest(edges: np.ndarray) -> np.ndarray:
    """Edges from each node to the least node of its component: as few as connect the same."""
    if not len(edges):
        return edges
    names, flat = np.unique(edges, return_inverse=True)
    a, b = flat.reshape(-1, 2).T
    label = np.arange(len(names))
    while True:
        la, lb = label[a], label[b]
        low = np.minimum(la, lb)
        before = label.copy()
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        label = label[label]
        while not np.array_equal(nxt := label[label], label):
            label = nxt
        if np.array_equal(before, label):
            break
    up = np.flatnonzero(label != np.arange(len(names)))
    return np.stack([names[label[up]], names[up]], 1)


def grouped(docs: DataFrame, distance: int, shared: int) -> DataFrame:
    """(doc_id, hi, lo, component) of each document's fingerprints; a component is named by one of its nodes. Rows that agree
    in all three are one."""
    prints = materialize(fingerprint_table(docs), "simhash")
    # a node of its own for each fingerprint: documents may share a doc_id
    distinct = prints.groupBy("hi", "lo").agg(F.lit(1)).select("hi", "lo", F.monotonically_increasing_id().alias("node"))
    nodes = materialize(distinct, "simhash-nodes")
    edges = materialize(near_pairs(postings(nodes), distance, shared), "simhash-edges")
    groups = connected_components(edges)
    named = nodes.join(groups, "node", "left").select("hi", "lo", F.coalesce("component", "node").alias("component"))
    return prints.join(named, ["hi", "lo"]).select("doc_id", "hi", "lo", "component")


def near_duplicates(docs: DataFrame, distance: int = MAX_DISTANCE, shared: int = MIN_SHARED) -> DataFrame:
    """(doc_id, group_id, group_size) of the documents that have a near copy; group_id is the smallest doc_id.

    Two documents are near copies if their SimHash fingerprints (128 bits over the distinct words, case folded) have `shared`
    equal bytes by position in one half and differ in at most `distance` bits; groups are the connected components. Each
    fingerprint is posted under its bytes by position, three positions of a half at a time (so postings stay short at
    any corpus size); pairs that meet are held against the count filter and then verified by their Hamming
    distance. No such pair is lost. Up to 11 bits the filter holds for every pair, so there it is the Hamming distance alone that
    counts; for what it leaves out beyond that see the README.

    Equal fingerprints are one node, so thousands of copies cost one posting list entry. Null doc_ids, null texts and texts
    without a word are in no group; rows that repeat a doc_id count once. Where rows of one doc_id have unlike texts, each text
    is in its own group, so the doc_id may have several rows. Only doc_id and text are read."""
    members = grouped(docs, distance, shared).select("doc_id", "component").distinct()
    sizes = members.groupBy("component").agg(F.count("*").alias("group_size"), F.min("doc_id").alias("group_id")).where("group_size > 1")
    return members.join(sizes, "component").select("doc_id", "group_id", "group_size")


def keep_one_of_each(docs: DataFrame, distance: int = MAX_DISTANCE, shared: int = MIN_SHARED) -> DataFrame:
    """The rows of docs, all columns as they were, but of each group of near copies only one: the row of the smallest doc_id (if
    it has several texts in the group, that of the smallest fingerprint; of rows with one fingerprint the smallest text, then any).

    Rows that share a doc_id but have unlike texts are in different groups, so each stays. Rows with a null doc_id, a null
    text or no word stay."""
    members = materialize(grouped(docs, distance, shared), "simhash-members")
    first = members.groupBy("component").agg(F.min(F.struct("doc_id", "hi", "lo")).alias("first"))
    gone = members.join(first, "component").where(F.struct("doc_id", "hi", "lo") != F.col("first")).select("doc_id", "hi", "lo")
    gone = materialize(gone.distinct().toDF("nf_doc", "nf_hi", "nf_lo"), "simhash-gone")
    key = docs["doc_id"].cast("long")
    # most corpora have no repeated doc_id, so what is to go is known by its doc_id
    again = docs.where("doc_id is not null").groupBy(key.alias("nf_again")).count().where("count > 1").select("nf_again")
    again = materialize(again, "repeated-rows")
    if again.isEmpty():
        return docs.join(gone.select("nf_doc"), key == gone["nf_doc"], "left_anti")
    rest = docs.join(again, key == again["nf_again"], "left_anti").join(gone.select("nf_doc"), key == F.col("nf_doc"), "left_anti")
    some = with_fingerprints(docs.join(again, key == again["nf_again"], "left_semi"))
    some = some.withColumn("nf_key", F.col("doc_id").cast("long"))
    left = some.join(gone, [some["nf_key"] == gone["nf_doc"], some["nf_own_hi"] == gone["nf_hi"], some["nf_own_lo"] == gone["nf_lo"]], "left_anti")
    # an aggregate in parts: a row may be repeated any number of times
    one = left.where("nf_own_hi is not null").groupBy("nf_key", "nf_own_hi", "nf_own_lo").agg(F.min_by(F.struct(*docs.columns), "text").alias("r")).select("r.*")
    return rest.unionByName(one).unionByName(left.where("nf_own_hi is null").select(*docs.columns))


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """docs with the columns nf_own_hi and nf_own_lo, null for a null text or one without a word."""
    at = docs.columns.index("text")
    names = [*docs.columns, "nf_own_hi", "nf_own_lo"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f, words = fingerprints(*string_spans(b.column(at)))
            two = np.ascontiguousarray(f).view(np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(two[:, i], mask=words == 0) for i in range(2))], names)

    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, T.LongType()) for n in names[-2:])])
    return docs.mapInArrow(run, schema)
