"""Line dedup by a log-template tree."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from operator import eq, itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Depth of the tree: the number of tokens, then so many leading tokens.
LEADING = 3
#: Share of a line's tokens after the leading ones that must equal a template's, place by place.
SIMILARITY = 0.7
#: Lines of fewer tokens are no templates: such short lines recur by chance, so they go by the exact line only.
MIN_TOKENS = 4
#: Documents that must have a short line before it counts as recurring; more if it is one token, as words recur by chance.
SHORT_DOCS = 20
WORD_DOCS = 64
WILD = "<*>"
_DIGIT = re.compile(r"\d").search
#: Lines are first compared within batches of about so many characters.
_COMBINE = 1 << 22


def masked_tokens(line: str) -> list[str]:
    """Tokens by white space; one with a digit is a variable field, and so is WILD where a text has it itself."""
    tokens = line.split()
    if _DIGIT(line):
        return [WILD if _DIGIT(t) else t for t in tokens]
    return tokens


def leaf_key(tokens: list[str], leading: int = LEADING) -> int:
    """The leaf of the tree where a line lies, as a signed 64-bit number."""
    return xxhash.xxh3_64_intdigest(f"{len(tokens)} {' '.join(tokens[:leading])}") - (1 << 63)


def enough_docs(n_tokens: int) -> int:
    return WORD_DOCS if n_tokens == 1 else SHORT_DOCS


class Leaf:
    """Templates of one leaf. A line joins the template with the most equal tokens (ties: the older), if these are
    enough, and turns the template's other tokens into wild ones; else it founds a template.

    Wild tokens count as unequal. A line and a template that differ in at most e places agree wholly on one of any e+1
    groups of places, so templates are looked up by their tokens in each group and only those are compared. The groups
    leave out the leading tokens, which all lines of the leaf share. Whenever the templates have doubled the groups are laid
    anew: places are dealt out by how many different tokens they have, so that no group consists of what all lines share.
    This changes no result, only how many templates are compared."""

    def __init__(self, n: int, leading: int, similarity: float):
        self.first = min(leading, n)
        rest = n - self.first
        self.need = self.first + int(np.ceil(similarity * rest - 1e-9))
        self.n, self.relay = n, 64
        self.templates: list[list[str]] = []
        self.docs: list[int] = []
        self.names: dict[str, str] = {}  # one object for each token
        self._lay(range(self.first, n))

    def _lay(self, places: Iterable[int]) -> None:
        """The groups, from places in the order of how telling they are, and the index by them."""
        k = self.n - self.need + 1
        groups: list[list[int]] = [[] for _ in range(k)]
        for i, p in enumerate(places):
            groups[i % k].append(p)
        self.groups = [(g, itemgetter(*ps)) for g, ps in enumerate(groups) if ps]
        self.index: dict[tuple, list[int]] = {}
        for t, tokens in enumerate(self.templates):
            self._post(t, tokens)

    def _keys(self, tokens: list[str]) -> list[tuple]:
        keys = [(g, pick(tokens)) for g, pick in self.groups]
        if WILD in tokens:  # it is equal to nothing
            return [k for k in keys if k[1] != WILD and (isinstance(k[1], str) or WILD not in k[1])]
        return keys

    def _post(self, t: int, tokens: list[str]) -> None:
        for key in self._keys(tokens):
            self.index.setdefault(key, []).append(t)

    def add(self, tokens: list[str], doc: int) -> int | None:
        """The document that founded the line's template, or None if the line founds one."""
        best, most = -1, self.need - 1
        keys, index = self._keys(tokens), self.index
        near = {t for key in keys if key in index for t in index[key]}
        probe = [None if x == WILD else x for x in tokens] if WILD in tokens else tokens
        for t in sorted(near) if len(near) > 1 else near:
            same = sum(map(eq, probe, self.templates[t]))
            if same > most:
                best, most = t, same
        if best >= 0:
            old = self.templates[best]
            if most < self.n:
                self.templates[best] = [x if x == y else WILD for x, y in zip(tokens, old)]
            return self.docs[best]
        tokens = [self.names.setdefault(x, x) for x in tokens]
        self.templates.append(tokens)
        self.docs.append(doc)
        self._post(len(self.templates) - 1, tokens)
        if len(self.templates) == self.relay:
            self.relay *= 2
            varied = [len({t[p] for t in self.templates}) for p in range(self.n)]
            self._lay(sorted(range(self.first, self.n), key=lambda p: -varied[p]))
        return None


def line_rows(docs: DataFrame, leading: int, least: int) -> DataFrame:
    """(leaf, doc_id, line, tokens): one row for every line that is not blank; a line of fewer than `least` tokens has its own
    tokens, others masked ones.

    Within a batch a masked line goes on from its smallest document only; in larger ones it is certain to be dropped,
    so those rows have no tokens and any leaf. A short line goes on from its smallest documents, as many as are enough to
    count as recurring; in larger ones it is certain too. A line that every document has thus meets in its leaf once (if
    short, at most `enough_docs` times) a batch, not once a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first: dict[str, tuple[int, list[int]]] = {}
            short: dict[str, dict[int, list[int]]] = {}
            certain: list[tuple[int, int]] = []
            held = 0

            def flush() -> pa.RecordBatch:
                leaf, doc, line, text = [], [], [], []
                placed = [(key, d, lines) for key, (d, lines) in first.items()]
                for key, held_by in short.items():
                    enough = enough_docs(key.count(" ") + 1)
                    for n, d in enumerate(sorted(held_by)):
                        if n < enough:
                            placed.append((key, d, held_by[d]))
                        else:
                            certain.extend((d, i) for i in held_by[d])
                for key, d, lines in placed:
                    k = leaf_key(key.split(" "), leading)
                    for i in lines:
                        leaf.append(k)
                        doc.append(d)
                        line.append(i)
                        text.append(key)
                for d, i in certain:
                    leaf.append(d)
                    doc.append(d)
                    line.append(i)
                    text.append(None)
                first.clear()
                short.clear()
                certain.clear()
                return pa.RecordBatch.from_arrays(
                    [pa.array(leaf, pa.int64()), pa.array(doc, pa.int64()), pa.array(line, pa.int32()), pa.array(text, pa.string())],
                    ["leaf", "doc_id", "line", "tokens"],
                )

            for d, text in zip(b.column(0).to_pylist(), b.column(1)):
                text = text.as_py()
                for i, line in enumerate(text.split("\n")):
                    tokens = masked_tokens(line)
                    if not tokens:
                        continue
                    if len(tokens) < least:
                        short.setdefault(" ".join(line.split()), {}).setdefault(d, []).append(i)
                        continue
                    key = " ".join(tokens)
                    had = first.get(key)
                    if had is None:
                        first[key] = (d, [i])
                    elif had[0] == d:
                        had[1].append(i)
                    elif had[0] < d:
                        certain.append((d, i))
                    else:
                        certain += [(had[0], j) for j in had[1]]
                        first[key] = (d, [i])
                held += len(text)
                if held > _COMBINE:
                    yield flush()
                    held = 0
            if first or short or certain:
                yield flush()

    rows = docs.where(F.col("doc_id").isNotNull() & (F.length("text") > 0))
    return rows.select(rows["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(
        run, "leaf long, doc_id long, line int, tokens string"
    )


def recurring_lines(docs: DataFrame, similarity: float = SIMILARITY, leading: int = LEADING, least: int = MIN_TOKENS) -> DataFrame:
    """(doc_id, line): lines, counted from 0, to be dropped.

    A line goes if a smaller document has the same masked line, or if it falls under a template that a smaller
    document founded. A line of fewer than `least` tokens goes if a smaller document has the very same tokens and
    enough_docs documents of the whole corpus have them. Lines enter their leaf in the order of (doc_id, line), so the
    result doesn't depend on how the corpus is split. Leaves are streamed in sorted order: only the templates of one leaf, 128
    bits of each of its different lines, and the lines of its short ones that are not yet in enough documents, are in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, tree, seen, waiting = None, None, {}, {}
        for b in batches:
            doc, line = [], []
            for k, d, i, key in zip(*(b.column(j).to_pylist() for j in range(4))):
                if key is None:
                    doc.append(d)
                    line.append(i)
                    continue
                if k != here:
                    here, tree, seen, waiting = k, None, {}, {}
                n = key.count(" ") + 1
                if n < least:
                    by_doc = waiting.setdefault(key, {})
                    if by_doc is None:  # in enough documents already, the smallest of which is kept
                        doc.append(d)
                        line.append(i)
                        continue
                    by_doc.setdefault(d, []).append(i)
                    if len(by_doc) == enough_docs(n):
                        for other in sorted(by_doc)[1:]:
                            doc.extend([other] * len(by_doc[other]))
                            line.extend(by_doc[other])
                        waiting[key] = None
                    continue
                name = xxhash.xxh3_128_digest(key)
                had = seen.get(name)
                if had is None:
                    tokens = key.split(" ")
                    if tree is None:
                        tree = {}
                    at = (len(tokens), *tokens[:leading])  # leaves whose keys collide stay apart
                    if at not in tree:
                        tree[at] = Leaf(len(tokens), leading, similarity)
                    founder = tree[at].add(tokens, d)
                    had = seen[name] = (d, founder is not None and founder != d)
                if had[1] or had[0] != d:
                    doc.append(d)
                    line.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(line, pa.int32())], ["doc_id", "line"])

    placed = line_rows(docs, leading, least).repartition("leaf").sortWithinPartitions("leaf", "doc_id", "line")
    return placed.mapInArrow(run, "doc_id long, line int")


def dedup_lines(
    docs: DataFrame, similarity: float = SIMILARITY, leading: int = LEADING, least: int = MIN_TOKENS, keep_emptied: bool = False
) -> DataFrame:
    """docs with its columns, text without its recurring lines (n_chars, where there is one, counts again), and
    nf_lines, nf_dropped: how many lines the text had and how many of them went.

    Of a template's documents the smallest keeps its lines. Lines of under `least` tokens go only if enough documents
    have the same one (enough_docs; again the smallest keeps it), blank ones stay. A document of
    which nothing but white space is left goes, unless keep_emptied. Null and empty texts and rows with a null
    doc_id stay as they are (nf_lines is null for a null text). Rows that share a doc_id are one document: the same line
    numbers go from each. Extra columns are carried along."""
    lines = recurring_lines(docs, similarity, leading, least)
    gone = lines.groupBy(F.col("doc_id").alias("nf_doc")).agg(F.collect_set("line").alias("nf_gone"))
    joined = docs.join(gone, docs["doc_id"].cast("long") == gone["nf_doc"], "left")
    parts = F.split("text", "\n", -1)
    kept = F.array_join(F.filter(parts, lambda _, i: ~F.array_contains(F.col("nf_gone"), i)), "\n")
    hit = F.col("nf_gone").isNotNull() & F.col("text").isNotNull()
    out = joined.withColumns({
        "nf_lines": F.when(F.col("text").isNotNull(), F.size(parts)),
        "nf_dropped": F.when(hit, F.size("nf_gone")).otherwise(F.lit(0)),
        "text": F.when(hit, kept).otherwise(F.col("text")),
    })
    if not keep_emptied:
        out = out.where((F.col("nf_dropped") == 0) | (F.trim(F.regexp_replace("text", r"\s+", " ")) != ""))
    if "n_chars" in docs.columns:
        n = F.when(F.col("nf_dropped") > 0, F.length("text")).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", n.cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns, "nf_lines", "nf_dropped")
