"""Repeated passages by a hash-compared suffix sort."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.textscan import SPACE, groups_of_rows, materialize, mix64, powers, runs, span_hashes, string_spans, words_of

#: A passage is repeated if it has so many words.
PASSAGE_WORDS = 50
#: Words of the spans that bring candidates together. Any passage of PASSAGE_WORDS words holds the least hash among its
#: PASSAGE_WORDS - SEED_WORDS + 1 spans of this length, so both copies of a passage meet under one seed.
SEED_WORDS = 20
#: Places of a seed that one task may hold, about 400 bytes each.
HOT_ROWS = 4096
_CHUNK = 1 << 19
_OTHER = np.uint64(0xD1B54A32D192ED03)
_SEGMENTS = 20_000
_INK = (1 - SPACE).astype(np.uint8)


def sliding_least(h: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """(least value, its first place) of h[i:i+w] for every i, by doubling."""
    value, place, have = h, np.arange(len(h)), 1
    while have < w:
        step = min(have, w - have)
        a, b = value[:-step], value[step:]
        right = b < a
        value, place = np.where(right, b, a), np.where(right, place[step:], place[:-step])
        have += step
    return value, place


def seeds(row: np.ndarray, h: np.ndarray, words: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, hash, first, last) for runs of passages of `words` words, from word first to word last, that have one seed:
    the span of `seed` words with the least hash in the passage, the first of equals."""
    n, w = len(h), words - seed + 1
    none = np.zeros(0, np.int64)
    if n < words:
        return none, np.zeros(0, np.uint64), none, none
    at = np.arange(n - seed + 1)
    g = span_hashes(h, at, at + seed)
    _, place = sliding_least(g, w)
    start = np.flatnonzero(row[: n - words + 1] == row[words - 1 :])  # passages within a row
    place = place[start]
    new = np.ones(len(start), bool)
    new[1:] = (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(start)] - 1 if len(start) else none
    return place[first], g[place[first]], start[first], start[last]


_SEED = "seed long, doc_id long, word int, back int, count int"


def seed_rows(docs: DataFrame, words: int, seed: int) -> DataFrame:
    """(seed, doc_id, word, back, count): each document's seeds; the passages that have one begin `back` words before its word
    and are `count`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = np.asarray(b.column(0))
            raw, starts, ends = string_spans(b.column(1))
            for lo, hi in groups_of_rows(starts, ends, _CHUNK):
                row, _, _, h = words_of(raw, starts[lo:hi], ends[lo:hi], _INK, fold=False)
                at, g, first, last = seeds(row, h, words, seed)
                base = np.searchsorted(row, np.arange(hi - lo))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(g.view(np.int64)),
                        pa.array(ids[lo:hi][row[at]]),
                        *(pa.array(x.astype(np.int32)) for x in (at - base[row[at]], at - first, last - first + 1)),
                    ],
                    ["seed", "doc_id", "word", "back", "count"],
                )

    return docs.mapInArrow(run, _SEED)


def seeded(rows: DataFrame, shared: DataFrame, words: int, seed: int) -> DataFrame:
    """(doc_id, text, seeds) of the rows that have a seed of `shared`, with the places of those."""
    own = seed_rows(rows, words, seed).join(shared.select("seed"), "seed", "left_semi")
    places = own.groupBy("doc_id").agg(F.collect_set(F.struct("word", "seed", "back", "count")).alias("seeds"))
    return rows.join(places, "doc_id").select("doc_id", "text", "seeds")


def segment_rows(docs: DataFrame, words: int, seed: int) -> DataFrame:
    """(seed, back, segment, doc_id, start): for each shared seed the words of all passages that have it, as they
    stand in the text, from `back` words before it; start counts characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, starts, ends = string_spans(b.column(1))
            for i, d in enumerate(b.column(0).to_pylist()):
                text = raw[starts[i] : ends[i]]
                ws, we = runs(_INK[text])
                chars = np.cumsum((text & 0xC0) != 0x80)
                data = text.tobytes()
                places = b.column(2)[i].values
                at, key, back, count = (np.asarray(places.field(k)).astype(np.int64) for k in range(4))
                stop = at - back + count - 1 + words
                ok = stop <= len(ws)  # rows that share a doc_id may have different texts
                at, key, back, stop = at[ok], key[ok], back[ok], stop[ok]
                s, e = ws[at - back], we[stop - 1]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(key),
                        pa.array(back.astype(np.int32)),
                        pa.array([data[x:y].decode("utf-8", "replace") for x, y in zip(s.tolist(), e.tolist())], pa.string()),
                        pa.array(np.full(len(at), d, np.int64)),
                        pa.array(chars[s].astype(np.int64) - 1 if len(at) else np.zeros(0, np.int64)),
                    ],
                    ["seed", "back", "segment", "doc_id", "start"],
                )

    return docs.mapInArrow(run, "seed long, back int, segment string, doc_id long, start long")


class Suffixes:
    """Suffixes of a sequence of symbols, compared over their first `most` symbols through one array of prefix
    polynomial hashes: a common extension is found by binary search, the order is that of the symbols after it."""

    def __init__(self, symbols: np.ndarray, most: int):
        self.symbols, self.most = symbols, most
        up, self.down = powers(len(symbols) + 1)
        with np.errstate(over="ignore"):
            self.prefix = np.zeros(len(symbols) + 1, np.uint64)
            np.cumsum(symbols * up[: len(symbols)], out=self.prefix[1:])

    def extension(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the longest common extension of each pair, at most `most`."""
        p, out = self.prefix, np.full(len(x), self.most, np.int64)
        px, py, dx, dy = p[x], p[y], self.down[x], self.down[y]
        with np.errstate(over="ignore"):
            # most pairs agree throughout; only the others are searched
            part = np.flatnonzero((p[x + self.most] - px) * dx != (p[y + self.most] - py) * dy)
            x, y, px, py, dx, dy = (v[part] for v in (x, y, px, py, dx, dy))
            low, step = np.zeros(len(part), np.int64), 1 << (self.most.bit_length() - 1)
            while step:
                n = np.minimum(low + step, self.most)
                low = np.where((p[x + n] - px) * dx == (p[y + n] - py) * dy, n, low)
                step >>= 1
        out[part] = low
        return out

    def less(self, x: np.ndarray, y: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        n = self.extension(x, y)
        whole = n >= self.most
        a, b = self.symbols[np.minimum(x + n, len(self.symbols) - 1)], self.symbols[np.minimum(y + n, len(self.symbols) - 1)]
        return np.where(whole, or_equal, a < b)

    def sort(self, suffix: np.ndarray, group: np.ndarray) -> np.ndarray:
        """suffix with each group (equal neighbours in `group`) sorted: merge sort from the bottom up, all groups at
        once; a merge places each suffix by binary search in the other run."""
        n = len(suffix)
        if not n:
            return suffix
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        size = np.diff(np.r_[first, n])
        base, count = np.repeat(first, size), np.repeat(size, size)
        local = np.arange(n) - base
        length = 1
        while length < int(size.max()):
            moving = np.flatnonzero(count > length)
            at = local[moving]
            run = at // length
            even = run % 2 == 0
            lo = np.where(even, run + 1, run - 1) * length
            start, hi = np.minimum(lo, count[moving]), np.minimum(lo + length, count[moving])
            lo, b, x = start.copy(), base[moving], suffix[moving]
            while True:
                live = np.flatnonzero(lo < hi)
                if not len(live):
                    break
                mid = (lo[live] + hi[live]) // 2
                # elements of the other run before x: the left run goes first among equals
                before = self.less(suffix[b[live] + mid], x[live], ~even[live])
                lo[live] = np.where(before, mid + 1, lo[live])
                hi[live] = np.where(before, hi[live], mid)
            place = b + (run // 2) * 2 * length + at % length + (lo - start)
            suffix = suffix.copy()
            suffix[place] = x
            length *= 2
        return suffix


def repeated_windows(texts: list[str], bucket: np.ndarray, back: np.ndarray, words: int) -> list[tuple[int, int, int]]:
    """(segment, start, end) in characters: the parts of segments that are covered by passages of `words` words which another
    segment of the bucket has at the same distance from the seed. Segments are distinct within their bucket; buckets lie
    together."""
    raw, starts, ends = string_spans(pa.array(texts, pa.string()))
    row, ws, we, symbols = words_of(raw, starts, ends, _INK, fold=False)
    count = np.bincount(row, minlength=len(texts))
    first = np.cumsum(np.r_[0, count])
    windows = np.maximum(count - words + 1, 0)
    seg = np.repeat(np.arange(len(texts)), windows)
    o = np.arange(len(seg)) - np.repeat(np.cumsum(np.r_[0, windows])[:-1], windows)
    # passages with the seed at the same distance lie in one group
    group = bucket[seg] * (4 * words) + (back[seg] - o + words)
    order = np.argsort(group, kind="stable")
    seg, o, group = seg[order], o[order], group[order]
    size = np.diff(np.r_[np.flatnonzero(np.r_[True, group[1:] != group[:-1]]), len(group)]) if len(group) else np.zeros(0, np.int64)
    many = np.repeat(size, size) > 1
    seg, o, group = seg[many], o[many], group[many]
    if not len(seg):
        return []
    s = Suffixes(symbols, words)
    suffix = s.sort(first[seg] + o, group)
    pair = np.flatnonzero(group[:-1] == group[1:])
    x, y = suffix[pair], suffix[pair + 1]
    same = s.extension(x, y) >= words
    x, y = x[same], y[same]
    # the hashes agree; now the words have to: neighbouring passages of the same two segments at once
    sx, sy = row[x], row[y]
    order = np.lexsort((x, sy, sx))
    x, y, sx, sy = x[order], y[order], sx[order], sy[order]
    fresh = np.ones(len(x), bool)
    fresh[1:] = (sx[1:] != sx[:-1]) | (sy[1:] != sy[:-1]) | (x[1:] - x[:-1] > words) | (x[1:] - y[1:] != x[:-1] - y[:-1])
    begin = np.flatnonzero(fresh)
    data = raw.tobytes()
    ok = np.ones(len(x), bool)
    for a, b in zip(begin.tolist(), np.r_[begin[1:], len(x)].tolist()):
        if not _agree(data, starts, ws, we, sx[a], sy[a], x[a], y[a], int(x[b - 1] - x[a]) + words):
            for i in range(a, b):
                ok[i] = _agree(data, starts, ws, we, sx[i], sy[i], x[i], y[i], words)
    hit = np.zeros(int(first[-1]) + 1, np.int64)
    at = np.unique(np.concatenate([x[ok], y[ok]]))
    np.add.at(hit, at, 1)
    np.add.at(hit, at + words, -1)
    covered = np.cumsum(hit)[:-1] > 0
    # a part ends with its segment
    edge = np.zeros(len(covered) + 1, bool)
    edge[first] = True
    a = np.flatnonzero(covered & (edge[:-1] | ~np.r_[False, covered[:-1]]))
    b = np.flatnonzero(covered & (edge[1:] | ~np.r_[covered[1:], False]))
    chars = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]
    place = lambda r, byte: chars[starts[r] + byte] - chars[starts[r]]
    return list(zip(row[a].tolist(), place(row[a], ws[a]).tolist(), place(row[b], we[b]).tolist()))


def _agree(data: bytes, starts: np.ndarray, ws: np.ndarray, we: np.ndarray, sx: int, sy: int, x: int, y: int, n: int) -> bool:
    """Whether n words from word x on are those from word y on, byte by byte; white space between them doesn't count."""
    one, two = data[starts[sx] + ws[x] : starts[sx] + we[x + n - 1]], data[starts[sy] + ws[y] : starts[sy] + we[y + n - 1]]
    return one == two or one.split() == two.split()


def _spans(rows: list[tuple], words: int) -> tuple[list[int], list[int], list[int]]:
    """Spans of the occurrences in whole buckets; rows: (seed, back, segment, [(doc, start)])."""
    doc, start, end = [], [], []
    shared: dict[int, int] = {}
    for r in rows:
        shared[r[0]] = shared.get(r[0], 0) + 1
    part: list[tuple[int, int, int]] = []
    for i, (_, _, text, where) in enumerate(rows):
        if len(where) > 1:  # all of the segment stands elsewhere, and it holds a passage at least
            part.append((i, 0, len(text)))
    many = [i for i, r in enumerate(rows) if shared[r[0]] > 1]
    if many:
        names = {s: k for k, s in enumerate(dict.fromkeys(rows[i][0] for i in many))}
        found = repeated_windows(
            [rows[i][2] for i in many], np.array([names[rows[i][0]] for i in many], np.int64), np.array([rows[i][1] for i in many], np.int64), words
        )
        part += [(many[k], a, b) for k, a, b in found if len(rows[many[k]][3]) == 1]
    for i, a, b in part:
        for d, s in rows[i][3]:
            doc.append(d)
            start.append(s + a)
            end.append(s + b)
    return doc, start, end


def passage_spans(segments: DataFrame, words: int) -> DataFrame:
    """(doc_id, start, end): spans of repeated passages, overlapping ones too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def out(done: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in _spans(done, words)], ["doc_id", "start", "end"])

        for b in batches:
            for seed, back, text, d, s in zip(*(b.column(i).to_pylist() for i in range(5))):
                last = rows[-1] if rows else None
                if last is not None and last[0] == seed and last[1] == back and last[2] == text:
                    if last[3][-1] != (d, s):
                        last[3].append((d, s))
                    continue
                if last is not None and last[0] != seed and len(rows) >= _SEGMENTS:
                    yield out(rows)
                    rows = []
                rows.append((seed, back, text, [(d, s)]))
        if rows:
            yield out(rows)

    placed = segments.repartition("seed").sortWithinPartitions("seed", "back", "segment", "doc_id", "start")
    return placed.mapInArrow(run, "doc_id long, start long, end long")


def window_rows(docs: DataFrame, words: int) -> DataFrame:
    """(h1, h2, doc_id, start, end): each passage that has one of the row's seeds, by two hashes of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, starts, ends = string_spans(b.column(1))
            for i, d in enumerate(b.column(0).to_pylist()):
                text = raw[starts[i] : ends[i]]
                ws, we = runs(_INK[text])
                places = b.column(2)[i].values
                at, back, count = (np.asarray(places.field(k)).astype(np.int64) for k in (0, 2, 3))
                ok = at - back + count - 1 + words <= len(ws)  # rows that share a doc_id may have different texts
                first, count = (at - back)[ok], count[ok]
                p = np.unique(np.repeat(first - np.cumsum(np.r_[0, count])[:-1], count) + np.arange(int(count.sum())))
                h = span_hashes(text, ws, we)
                two = [span_hashes(x, p, p + words) for x in (h, mix64(h ^ _OTHER))]
                chars = np.cumsum((text & 0xC0) != 0x80)
                start, end = chars[ws[p]] - 1, chars[we[p + words - 1] - 1]
                for lo in range(0, len(p), _SEGMENTS):
                    part = slice(lo, lo + _SEGMENTS)
                    yield pa.RecordBatch.from_arrays(
                        [
                            *(pa.array(x[part].view(np.int64)) for x in two),
                            pa.array(np.full(len(p[part]), d, np.int64)),
                            *(pa.array(x[part].astype(np.int64)) for x in (start, end)),
                        ],
                        ["h1", "h2", "doc_id", "start", "end"],
                    )

    return docs.mapInArrow(run, "h1 long, h2 long, doc_id long, start long, end long")


def window_spans(windows: DataFrame) -> DataFrame:
    """(doc_id, start, end) of the windows that stand in two places. Copies are aggregated before they are shuffled; the join
    back is one that adaptive execution splits."""
    key, at = ["h1", "h2"], ["doc_id", "start"]
    both = windows.groupBy(key).agg(*(f(c).alias(f"{n}_{c}") for c in at for n, f in (("low", F.min), ("high", F.max))))
    shared = materialize(both.where("low_doc_id <> high_doc_id or low_start <> high_start").select(key), "passages-shared")
    return windows.join(shared, key, "left_semi").select("doc_id", "start", "end")


def merged_spans(spans: DataFrame) -> DataFrame:
    """(doc_id, start, end) with overlapping and adjoining spans of a document as one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list[int] | None = None
        for b in batches:
            done = []
            for d, s, e in zip(*(b.column(i).to_pylist() for i in range(3))):
                if open_ is not None and open_[0] == d and s <= open_[2]:
                    open_[2] = max(open_[2], e)
                else:
                    if open_ is not None:
                        done.append(open_)
                    open_ = [d, s, e]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*done) if done else [()] * 3)], ["doc_id", "start", "end"])
        if open_ is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in open_], ["doc_id", "start", "end"])

    return spans.repartition("doc_id").sortWithinPartitions("doc_id", "start", "end").mapInArrow(run, "doc_id long, start long, end long")


def repeated_passages(docs: DataFrame, words: int = PASSAGE_WORDS, seed: int = SEED_WORDS, hot: int = HOT_ROWS) -> DataFrame:
    """(doc_id, start, end): the spans of each text that are covered by passages of `words` words (by white space,
    exactly equal) which stand in another place of the corpus too, in another document or in the same.

    start and end count characters from 0, end excluded. A passage counts wherever it stands, the first place
    included. Null doc_ids, null or empty texts and texts of fewer words have no span; rows that repeat a doc_id with its
    text count once. Only doc_id and text are read.

    Passages of the whole corpus are brought together by seeds (see SEED_WORDS), about two in 32 words, of which only
    those that stand in two places go on. The words of the passages that have a shared seed, 65 on average, go to the seed's
    bucket, where equal segments collapse as they stream by in sorted order and the suffixes of the rest are sorted.
    A seed of more than `hot` places has no bucket, which one task would have to take: its passages meet one by one under 128
    bits of hashes, aggregated before they are shuffled. The spans are the same either way."""
    rows = docs.where(F.col("doc_id").isNotNull() & (F.length("text") > 0))
    rows = rows.select(rows["doc_id"].cast("long").alias("doc_id"), "text")
    shared = materialize(seed_rows(rows, words, seed).groupBy("seed").agg(F.count("*").alias("n")).where("n > 1"), "seeds")
    spans = passage_spans(segment_rows(seeded(rows, shared.where(F.col("n") <= hot), words, seed), words, seed), words)
    most = shared.where(F.col("n") > hot)
    if not most.isEmpty():
        windows = materialize(window_rows(seeded(rows, most, words, seed), words), "passages")
        spans = spans.union(window_spans(windows))
    return merged_spans(spans)
