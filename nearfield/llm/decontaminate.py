"""Benchmark decontamination: one Aho-Corasick automaton over the words of the normalised test items."""

from __future__ import annotations

import uuid
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.suffix_dedup import sliding_least
from nearfield.llm.textscan import mix64, plain_words, span_hashes

WINDOW_WORDS = 13
#: Items of fewer words have no pattern: one to three words stand in texts that never saw the test.
MIN_WORDS = 4
#: Words of the automaton's patterns: of each window the span of so many words with the least hash.
SEED_WORDS = 6
#: Bytes of test items that one automaton holds; a larger suite is scanned in parts.
PART_BYTES = 8 << 20
SCHEMA = "doc_id long, item_id long, start long, end long, n_windows long"
_matchers: dict[str, Matcher] = {}


def normalise(text: str) -> str:
    """Words in lower case, one space between."""
    return " ".join(plain_words(text)).lower()


class Matcher:
    """Finds windows of `window` words of the items (whole items, if shorter) in texts.

    The automaton's symbols are words. Its patterns are not the windows, of which every word of an item begins one, but one
    span of SEED_WORDS words in each window, the one with the least hash: neighbouring windows share it, so about two
    words in nine begin a pattern. A text that holds a window holds its span; where the automaton finds a span, the
    equal words around it are counted in the item itself, so what is found are exactly the windows."""

    def __init__(self, items: list[tuple[int, str]], window: int = WINDOW_WORDS, least: int = MIN_WORDS, seed: int = SEED_WORDS):
        self.window, self.ids, self.number, lengths, flat = window, [], {}, [], array("i")
        number = self.number
        for item, text in items:
            words = normalise(text).split()
            if len(words) >= least:
                flat.extend([number.setdefault(w, len(number) + 1) for w in words])
                self.ids.append(item)
                lengths.append(len(words))
        self.flat = np.frombuffer(flat, np.int32) if flat else np.zeros(0, np.int32)
        self.first = np.r_[0, np.cumsum(lengths, dtype=np.int64)]
        seed = min(seed, window)
        at = np.zeros(0, np.int64)
        if len(self.flat) >= window:
            where = np.arange(len(self.flat) - seed + 1)
            _, place = sliding_least(span_hashes(mix64(self.flat.astype(np.uint64)), where, where + seed), window - seed + 1)
            item = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
            at = np.unique(place[item[: len(item) - window + 1] == item[window - 1 :]])  # of windows within an item
        size = np.full(len(at), seed)
        # items shorter than a window: their first words
        short = np.flatnonzero(np.array(lengths, np.int64) < window)
        at, size = np.r_[at, self.first[short]], np.r_[size, np.minimum(np.array(lengths, np.int64)[short], seed)]
        spans = np.zeros((len(at), seed), np.int32)
        for k in range(seed):
            spans[size > k, k] = self.flat[at[size > k] + k]
        # equal spans are one pattern; its places lie together
        spans, of = np.unique(spans, axis=0, return_inverse=True)
        order = np.argsort(of.ravel(), kind="stable")
        self.places = at[order]
        self.group = np.searchsorted(of.ravel()[order], np.arange(len(spans) + 1))
        self.sizes = (spans > 0).sum(1)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for i, n in enumerate(self.sizes.tolist()):
            self.automaton.add_word(tuple(spans[i, :n].tolist()), i)
        if len(spans):
            self.automaton.make_automaton()

    def windows(self, words: list[str]) -> dict[int, dict[int, int]]:
        """Where windows begin, by item: the index of the first word, and the words of the window."""
        by_item: dict[int, dict[int, int]] = {}
        if not self.ids or not words:
            return by_item
        get = self.number.get
        ids = tuple([get(w, 0) for w in words])
        flat, n, done = self.flat, len(ids), {}
        for stop, i in self.automaton.iter(ids):
            size = int(self.sizes[i])
            p = stop - size + 1
            for q in self.places[self.group[i] : self.group[i + 1]].tolist():
                if done.get(p - q, 0) > p:
                    continue  # lies in the equal words around an earlier span
                k = int(np.searchsorted(self.first, q, "right")) - 1
                low, high = int(self.first[k]), int(self.first[k + 1])
                a, b, end = p, p + size, q + size
                while a > 0 and q > low and ids[a - 1] == flat[q - 1]:
                    a, q = a - 1, q - 1
                while b < n and end < high and ids[b] == flat[end]:
                    b, end = b + 1, end + 1
                done[a - q] = b
                need = min(self.window, high - low)
                if b - a >= need:
                    by_item.setdefault(self.ids[k], {}).update(dict.fromkeys(range(a, b - need + 1), need))
        return by_item


def scan(text: str, matcher: Matcher) -> list[tuple[int, int, int, int]]:
    """(item, start, end, windows) by item and start: matched windows of an item whose words overlap or adjoin
    are one span. The normalised text is scanned once; only if something matched are its words laid against
    the original, whose characters start and end count."""
    words = plain_words(text)
    # lower() may change a word's length, not the number of words
    by_item = matcher.windows(" ".join(words).lower().split(" ")) if words else {}
    if not by_item:
        return []
    ends, here = [], 0
    for w in words:
        here = text.index(w, here) + len(w)
        ends.append(here)
    out = []
    for item in sorted(by_item):
        spans: list[list[int]] = []
        for a, n in sorted(by_item[item].items()):
            b = a + n - 1
            if spans and a <= spans[-1][1] + 1:
                spans[-1][1] = max(spans[-1][1], b)
                spans[-1][2] += 1
            else:
                spans.append([a, b, 1])
        out += [(item, ends[a] - len(words[a]), ends[b], n) for a, b, n in spans]
    return out


def parts_of(items: Iterator[tuple[int, str]], most: int) -> Iterator[list[tuple[int, str]]]:
    """Consecutive items of at most `most` bytes together; a larger one is a part of its own."""
    part: list[tuple[int, str]] = []
    held = 0
    for item, text in items:
        size = len(text.encode("utf-8", "surrogatepass"))
        if part and held + size > most:
            yield part
            part, held = [], 0
        part.append((item, text))
        held += size
    if part:
        yield part


def spans_of(docs: DataFrame, sent: Broadcast, window: int, least: int) -> DataFrame:
    """The spans of one part of the items."""
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _matchers:
            _matchers.clear()
            _matchers[key] = Matcher(sent.value, window, least)
        matcher = _matchers[key]
        for b in batches:
            rows = []
            for d, text in zip(b.column(0).to_pylist(), b.column(1)):
                if text := text.as_py():
                    rows += [(d, *s) for s in scan(text, matcher)]
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns], ["doc_id", "item_id", "start", "end", "n_windows"]
            )

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def contaminated_spans(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW_WORDS, least: int = MIN_WORDS, part_bytes: int = PART_BYTES
) -> DataFrame:
    """(doc_id, item_id, start, end, n_windows): the spans of each text that repeat `window` words of an item.

    Texts and items are compared as lower-case words (\\w+), so case, punctuation and white space don't matter.
    start and end count characters of the original text, from 0, end excluded; n_windows is how many windows
    matched. An item of fewer words than `window` matches whole, one of under `least` words never. Null or empty
    texts and items match nothing; rows with a null item_id are left out of the benchmark; repeated document rows
    give repeated spans, a repeated item none; texts of any length are scanned whole. An empty benchmark gives no rows. Only
    doc_id, text and item_id, text are read. Narrow: the items go to the workers in parts of at most part_bytes, for each of
    which the texts are scanned once; an item lies in one part, so the result is the same at any size."""
    items = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(
        F.col("item_id").cast("long").alias("item_id"), "text"
    )
    spark = docs.sparkSession
    out = None
    for part in parts_of(((r[0], r[1]) for r in items.distinct().toLocalIterator()), part_bytes):
        one = spans_of(docs, spark.sparkContext.broadcast(part), window, least)
        out = one if out is None else out.unionByName(one)
    return spark.createDataFrame([], SCHEMA) if out is None else out


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW_WORDS, least: int = MIN_WORDS) -> DataFrame:
    """The rows of docs, all columns as they were, without the documents in which contaminated_spans() finds any.

    Documents with a null doc_id or a null text stay, as do all if the benchmark is empty. If rows share a doc_id
    and one is contaminated, all of them go."""
    bad = contaminated_spans(docs, benchmark, window, least).select(F.col("doc_id").alias("nf_bad_doc")).distinct()
    return docs.join(bad, docs["doc_id"].cast("long") == bad["nf_bad_doc"], "left_anti")


ORACLE = rf"""
WITH item AS (
  SELECT DISTINCT item_id, list_transform(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+'), lambda x: lower(x)) AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
pattern AS (
  SELECT DISTINCT item_id, least({WINDOW_WORDS}, len(w)) AS n,
         unnest(list_transform(range(1, len(w) - least({WINDOW_WORDS}, len(w)) + 2),
                lambda i: array_to_string(w[i:i + least({WINDOW_WORDS}, len(w)) - 1], ' '))) AS gram
  FROM item WHERE len(w) >= {MIN_WORDS}),
doc AS (
  SELECT doc_id, text, regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+') AS w,
         regexp_extract_all(text, '[^\p{{L}}\p{{N}}_]+') AS s,
         regexp_matches(text, '^[^\p{{L}}\p{{N}}_]') AS lead
  FROM documents WHERE text IS NOT NULL),
gram AS (
  SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS p,
         unnest(list_transform(range(1, len(w) - n + 2), lambda i: lower(array_to_string(w[i:i + n - 1], ' ')))) AS gram
  FROM doc, (SELECT DISTINCT n FROM pattern) WHERE len(w) >= n),
hit AS (
  SELECT g.doc_id, p.item_id, g.p AS a, g.p + g.n - 1 AS b FROM gram g JOIN pattern p ON g.gram = p.gram AND g.n = p.n),
mark AS (
  SELECT *, CASE WHEN a <= 1 + max(b) OVER (PARTITION BY doc_id, item_id ORDER BY a, b
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM hit),
island AS (
  SELECT *, sum(fresh) OVER (PARTITION BY doc_id, item_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS k FROM mark),
span AS (
  SELECT doc_id, item_id, min(a) AS a, max(b) AS b, count(*) AS n_windows FROM island GROUP BY doc_id, item_id, k)
SELECT s.doc_id, s.item_id,
  CAST(coalesce(list_sum(list_transform(d.w[1:s.a - 1], lambda x: length(x))), 0)
     + coalesce(list_sum(list_transform(d.s[1:s.a - 1 + d.lead::INT], lambda x: length(x))), 0) AS BIGINT) AS start,
  CAST(list_sum(list_transform(d.w[1:s.b], lambda x: length(x)))
     + coalesce(list_sum(list_transform(d.s[1:s.b - 1 + d.lead::INT], lambda x: length(x))), 0) AS BIGINT) AS "end",
  s.n_windows
FROM span s JOIN doc d USING (doc_id)
"""
