"""Language identification by prediction by partial matching (PPM)."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm.textscan import groups_of_rows, string_spans

ORDER = 3
#: Bound of the labelled sample: so many documents a language, those of the smallest hash of doc_id.
TRAIN_DOCS = 300
#: Contexts seen less often in all languages together are left out of the tree, at every order above 0.
MIN_CONTEXT = 4
#: A text is rejected if its best language takes more bits than evenly drawn bytes of those that the sample has would (about 6.6
#: a byte; the languages' own texts take 2 to 4), and so many more: few words tell little.
SLACK_BITS = 32.0
#: And if another language than its label's takes so many bits less: the label is then wrong, or the text not of one language.
LABEL_BITS = 100.0
#: The tables go to every worker; more than this is refused.
MAX_MODEL_BYTES = 512 << 20
_CHUNK = 1 << 19
SCHEMA = "doc_id long, language string, bits_per_byte double, margin_bits double, accepted boolean"
_models: dict[str, PPM] = {}


class PPM:
    """Variable-order byte context trees, one for each language over a common set of contexts, frozen.

    Escapes are by method C with exclusion: in a context with n symbols of q kinds a symbol seen c times has the
    probability c / (n + q) and the escape q / (n + q); after an escape the next shorter context counts without
    the kinds already excluded, the last resort being all bytes not excluded, evenly. With the statistics frozen, the
    code length of a byte is a function of the longest kept context before it, so both are tabulated:
    step[state, class] leads to the next longer context, bits[state, class, language] is the code length."""

    def __init__(self, samples: dict[str, list[bytes]], order: int = ORDER, min_context: int = MIN_CONTEXT):
        self.order, self.languages = order, sorted(samples)
        joined = {k: np.frombuffer(b"".join(samples[k]), np.uint8) for k in self.languages}
        seen = np.zeros(256, bool)
        for x in joined.values():
            seen[np.unique(x)] = True
        self.classes = int(seen.sum())
        self.of_byte = np.full(256, self.classes, np.int64)  # the last class: bytes that no sample has
        self.of_byte[seen] = np.arange(self.classes)
        a = self.classes
        grams: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        for k in self.languages:
            grams[k] = [self._count([x for x in samples[k] if x], j + 1) for j in range(order + 1)]
        # nodes by order: a context's code has its nearest byte as the least digit, so code // a drops the farthest
        nodes = [np.zeros(1, np.int64)]
        for j in range(1, order + 1):
            every = np.concatenate([grams[k][j][0] // a for k in self.languages] or [np.zeros(0, np.int64)])
            weight = np.concatenate([grams[k][j][1] for k in self.languages] or [np.zeros(0, np.int64)])
            codes, where = np.unique(every, return_inverse=True)
            codes = codes[np.bincount(where, weight, len(codes)) >= min_context] if len(codes) else codes
            nodes.append(codes[np.isin(codes % a ** (j - 1), nodes[-1])])
        base = np.cumsum([0] + [len(x) for x in nodes])
        self.states = m = int(base[-1])
        counts = {}
        for k in self.languages:
            rows = []
            for j in range(order + 1):
                c = np.zeros((len(nodes[j]), a), np.int64)
                code, n = grams[k][j]
                ctx = code // a
                at = np.searchsorted(nodes[j], ctx)
                ok = (at < len(nodes[j])) & (nodes[j][np.minimum(at, len(nodes[j]) - 1)] == ctx) if len(nodes[j]) else np.zeros(len(ctx), bool)
                c[at[ok], code[ok] % a] = n[ok]
                rows.append(c)
            counts[k] = rows
        self.bits = np.zeros((m, a + 1, max(1, len(self.languages))), np.float32)
        for number, k in enumerate(self.languages):
            for j in range(order + 1):
                self.bits[base[j] : base[j + 1], :, number] = self._lengths(counts[k], nodes, j)
        # state m + s is s with no longer context to come
        self.step = np.tile(np.arange(2 * m, dtype=np.int64)[:, None], (1, a + 1))
        self.step[:m] += m
        for j in range(order):
            up = nodes[j + 1]
            parent = base[j] + np.searchsorted(nodes[j], up % a**j)
            self.step[parent, up // a**j] = base[j + 1] + np.arange(len(up))
        self.step = self.step.astype(np.int32)

    def _count(self, texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
        """Codes and counts of the n-grams: the context's farthest byte is the highest digit, the symbol the least."""
        parts = [np.zeros(0, np.int64)]
        for t in texts:
            c = self.of_byte[np.frombuffer(t, np.uint8)]
            if len(c) >= n:
                code = np.zeros(len(c) - n + 1, np.int64)
                for i in range(n):
                    code = code * self.classes + c[i : len(c) - n + 1 + i]
                parts.append(code)
        return np.unique(np.concatenate(parts), return_counts=True)

    def _lengths(self, counts: list[np.ndarray], nodes: list[np.ndarray], j: int) -> np.ndarray:
        a, rows = self.classes, len(nodes[j])
        out = np.zeros((rows, a + 1))
        gone, escaped = np.zeros((rows, a), bool), np.zeros(rows)
        for k in range(j, -1, -1):
            at = np.searchsorted(nodes[k], nodes[j] % a**k)
            c = np.where(gone, 0, counts[k][at])
            n, q = c.sum(1), (c > 0).sum(1)
            hit = c > 0
            total = (n + q)[:, None]
            with np.errstate(divide="ignore", invalid="ignore"):
                bits = np.log2(total / c)
                out[:, :a] = np.where(hit, escaped[:, None] + bits, out[:, :a])
                escaped = escaped + np.where(n > 0, np.log2((n + q) / np.maximum(q, 1)), 0)
            gone |= hit
        last = escaped + np.log2(np.maximum(1, 256 - gone.sum(1)))
        out[:, :a] = np.where(gone, out[:, :a], last[:, None])
        out[:, a] = last
        return out

    @property
    def nbytes(self) -> int:
        return self.bits.nbytes + self.step.nbytes

    def code_lengths(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Bits of every span under every language: (spans, languages). The context never crosses a span's start."""
        n, m, a = len(starts), self.states, self.classes + 1
        out = np.zeros((n, len(self.languages)))
        bits = self.bits.reshape(m * a, -1)
        step = self.step.reshape(-1)
        for lo, hi in groups_of_rows(starts, ends, _CHUNK):
            for a0 in range(int(starts[lo]), int(ends[hi - 1]), _CHUNK):
                a1 = min(a0 + _CHUNK, int(ends[hi - 1]))
                # rows that reach into the bytes a0 to a1; before them so many bytes of context
                b0 = max(0, a0 - self.order)
                c = self.of_byte[raw[b0:a1]]
                skip, size = a0 - b0, a1 - a0
                state = np.zeros(size, np.int64)
                for back in range(1, self.order + 1):
                    prior = np.full(size, self.classes, np.int64)
                    from_ = skip - back
                    prior[max(0, -from_) :] = c[max(0, from_) : from_ + size]
                    for j in range(back):  # the first bytes of a row have shorter contexts
                        p = starts[lo:hi] + j - a0
                        prior[p[(p >= 0) & (p < size)]] = self.classes
                    state = step[state * a + prior].astype(np.int64)
                state[state >= m] -= m
                took = bits[state * a + c[skip:]].astype(np.float64)
                s, e = np.clip(starts[lo:hi], a0, a1) - a0, np.clip(ends[lo:hi], a0, a1) - a0
                total = np.zeros((size + 1, took.shape[1]))
                np.cumsum(took, axis=0, out=total[1:])
                if len(self.languages):
                    out[lo:hi] += total[e] - total[s]
        return out


def training_sample(docs: DataFrame, per_language: int) -> dict[str, list[bytes]]:
    """Whole texts of at most per_language labelled rows for each language: those of the smallest hashes of doc_id."""
    labelled = docs.where("lang is not null and doc_id is not null and text is not null").select("doc_id", "lang")
    w = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = labelled.withColumn("nf_rank", F.row_number().over(w)).where(F.col("nf_rank") <= per_language)
    rows = docs.select("doc_id", "lang", "text").where("lang is not null and text is not null").join(F.broadcast(ids.select("doc_id", "lang").distinct()), ["doc_id", "lang"])
    found: dict[str, list[bytes]] = {}
    for r in rows.select("lang", "text").toLocalIterator():
        found.setdefault(r[0], []).append(r[1].encode())
    return {k: sorted(v) for k, v in found.items()}


def train(docs: DataFrame, per_language: int = TRAIN_DOCS, order: int = ORDER, min_context: int = MIN_CONTEXT) -> PPM:
    """The frozen model of a bounded labelled sample; see training_sample()."""
    return PPM(training_sample(docs, per_language), order, min_context)


def judged(model: PPM, batch: pa.RecordBatch, text: int, lang: int | None, slack_bits: float, label_bits: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code lengths by language, bytes, whether it is accepted) of each row."""
    raw, starts, ends = string_spans(batch.column(text))
    sizes = ends - starts
    lengths = model.code_lengths(raw, starts, ends)
    ok = sizes > 0
    if model.languages:
        best = lengths.min(1)
        ok &= best <= sizes * np.log2(max(2, model.classes)) + slack_bits
        if lang is not None:
            number = {k: i for i, k in enumerate(model.languages)}
            own = np.array([number.get(x, -1) for x in batch.column(lang).to_pylist()], np.int64)
            ok &= (own < 0) | (lengths[np.arange(len(own)), own] - best <= label_bits)
    return lengths, sizes, ok


def sent_model(docs: DataFrame, model: PPM):
    """A function that gives the model in a worker."""
    if model.nbytes > MAX_MODEL_BYTES:
        raise ValueError(f"{model.nbytes} bytes of context tables; at most {MAX_MODEL_BYTES} are sent to the workers")
    sent, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def get() -> PPM:
        if key not in _models:
            _models.clear()
            _models[key] = sent.value
        return _models[key]

    return get


def identify(docs: DataFrame, model: PPM, slack_bits: float = SLACK_BITS, label_bits: float = LABEL_BITS) -> DataFrame:
    """(doc_id, language, bits_per_byte, margin_bits, accepted) for every row of docs.

    language has the smallest exact code length for the whole text (ties: the first by name), bits_per_byte is that
    length over the text's UTF-8 bytes, margin_bits how many bits more the second takes (null with one language).
    accepted: the length is at most slack_bits more than that of evenly drawn bytes of those the sample has, and, if docs has
    a column lang with a language of the model, at most label_bits less than under that. A null or empty text has no language and
    is not accepted. With no labelled row there is no model: language is null and every text that is not empty is accepted.
    Only doc_id, text and lang are read; repeated rows give repeated results; texts of any length are judged whole. Narrow:
    no shuffle; the tables, whose size depends on the bounded sample only, go to the workers."""
    get, lang = sent_model(docs, model), 2 if "lang" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = get()
        for b in batches:
            lengths, sizes, ok = judged(m, b, 1, lang, slack_bits, label_bits)
            empty = sizes == 0
            if m.languages:
                name = pa.array(np.array(m.languages, object)[lengths.argmin(1)], pa.string(), mask=empty)
                second = np.partition(lengths, 1, axis=1)[:, 1] - lengths.min(1) if len(m.languages) > 1 else np.zeros(len(sizes))
                margin = pa.array(second, pa.float64(), mask=empty | (len(m.languages) < 2))
                rates = pa.array(lengths.min(1) / np.maximum(sizes, 1), pa.float64(), mask=empty)
            else:
                name, margin, rates = pa.nulls(len(sizes), pa.string()), pa.nulls(len(sizes), pa.float64()), pa.nulls(len(sizes), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), name, rates, margin, pa.array(ok, pa.bool_())],
                ["doc_id", "language", "bits_per_byte", "margin_bits", "accepted"],
            )

    columns = [docs["doc_id"].cast("long").alias("doc_id"), docs["text"], *([docs["lang"].cast("string").alias("lang")] if lang else [])]
    return docs.select(*columns).mapInArrow(run, SCHEMA)


def keep_identified(docs: DataFrame, model: PPM, slack_bits: float = SLACK_BITS, label_bits: float = LABEL_BITS) -> DataFrame:
    """The rows of docs, all columns as they were, that the model accepts: see identify(). One narrow pass, so rows
    that share a doc_id or have none are judged each by its own text."""
    names = docs.columns
    get, text, lang = sent_model(docs, model), names.index("text"), names.index("lang") if "lang" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = get()
        for b in batches:
            yield b.filter(pa.array(judged(m, b, text, lang, slack_bits, label_bits)[2], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
