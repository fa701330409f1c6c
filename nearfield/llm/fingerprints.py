"""Document fingerprints from prefix polynomial hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm.textscan import materialize

#: Two primes below 2**31: products of two residues fit a signed 64-bit integer.
MODULI = (2147483647, 2147483629)
BASES = (1000003, 998244353)
LEAD_CHARS = 64
_powers: dict[int, np.ndarray] = {}


def power_table(which: int, n: int) -> np.ndarray:
    """BASES[which]**i modulo MODULI[which] for i < n, by doubling."""
    have = _powers.get(which)
    if have is None or len(have) < n:
        p, b = MODULI[which], BASES[which]
        have = np.ones(1, np.int64)
        while len(have) < n:
            have = np.concatenate([have, have * pow(b, len(have), p) % p])
        _powers[which] = have
    return have


class PrefixHash:
    """Prefix arrays of a text: S[i] = sum of code(j) * B**j for j < i, modulo two primes."""

    def __init__(self, text: str):
        self.codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        self.n = len(self.codes)
        self.s = []
        for k, p in enumerate(MODULI):
            s = np.zeros(self.n + 1, np.int64)
            # terms are below 2**31, so 2**32 of them can be added before the one remainder
            np.cumsum(self.codes * power_table(k, self.n + 1)[: self.n] % p, out=s[1:])
            self.s.append(s % p)

    def fingerprint(self) -> tuple[int, int]:
        return int(self.s[0][-1]), int(self.s[1][-1])

    def equal(self, i: int, other: PrefixHash, j: int, n: int) -> bool:
        """Whether n characters from i on hash like n of other from j on: one comparison, whatever n is."""
        if i + n > self.n or j + n > other.n:
            return False
        for k, p in enumerate(MODULI):
            a, b = int(self.s[k][i + n] - self.s[k][i]) % p, int(other.s[k][j + n] - other.s[k][j]) % p
            up = power_table(k, max(i, j) + 1)
            if a * int(up[j]) % p != b * int(up[i]) % p:
                return False
        return True

    def extension(self, i: int, other: PrefixHash, j: int) -> int:
        """Longest common extension from i and j: binary search over equal(), then checked by characters."""
        low, high = 0, min(self.n - i, other.n - j)
        while low < high:
            mid = (low + high + 1) // 2
            if self.equal(i, other, j, mid):
                low = mid
            else:
                high = mid - 1
        if not np.array_equal(self.codes[i : i + low], other.codes[j : j + low]):  # a collision of both primes
            low = int(np.argmax(self.codes[i : i + low] != other.codes[j : j + low]))
        return low


def fingerprint_rows(docs: DataFrame, lead_chars: int = LEAD_CHARS) -> DataFrame:
    """(doc_id, n, fp_a, fp_b, lead_a, lead_b): hashes of the whole text and of its leading span."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, a, c, la, lb = [], [], [], [], []
            for text in b.column(1):
                text = text.as_py()
                if text is None:
                    for x in (n, a, c, la, lb):
                        x.append(None)
                    continue
                h = PrefixHash(text)
                m = min(lead_chars, h.n)
                n.append(h.n)
                a.append(int(h.s[0][-1]))
                c.append(int(h.s[1][-1]))
                la.append(int(h.s[0][m]))
                lb.append(int(h.s[1][m]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(x, pa.int64()) for x in (n, a, c, la, lb))],
                ["doc_id", "n", "fp_a", "fp_b", "lead_a", "lead_b"],
            )

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n long, fp_a long, fp_b long, lead_a long, lead_b long"
    )


#: Up to so many leading spans that documents share are sent to the workers, 17 bytes each in sorted arrays.
MAX_SENT_LEADS = 4_000_000


class LeadTable:
    """Documents by leading span (two hashes below 2**31 and a length) in sorted arrays."""

    def __init__(self, a: np.ndarray, b: np.ndarray, n: np.ndarray, doc: np.ndarray):
        key = (a.astype(np.int64) << 31) | b.astype(np.int64)
        order = np.lexsort((n, key))
        self.key, self.n, self.doc = key[order], n[order].astype(np.uint8 if not len(n) or n.max() < 256 else np.int64), doc[order]

    def find(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents, whether there is one) of each span."""
        key = (a << 31) | b
        at = np.searchsorted(self.key, key)
        hit, doc = np.zeros(len(key), bool), np.zeros(len(key), np.int64)
        live = np.flatnonzero(at < len(self.key))
        while len(live):  # more than once only where the hashes of spans of different lengths collide
            live = live[self.key[at[live]] == key[live]]
            same = live[self.n[at[live]] == n[live]]
            hit[same], doc[same] = True, self.doc[at[same]]
            at[live] += 1
            live = live[~hit[live] & (at[live] < len(self.key))]
        return doc, hit


def texts_of_shared(docs: DataFrame, shared: DataFrame, lead_chars: int, most: int = MAX_SENT_LEADS) -> DataFrame:
    """(lead_doc, doc_id, text) of the documents whose leading span others have; shared: (lead_a, lead_b, lead_n,
    lead_doc). The spans are sent to the workers, which then send on such texts only; if they are more than `most`, the
    texts meet them in a shuffle by document instead."""
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if sent is None else sent.value
        for b in batches:
            keys = []
            for text in b.column(1):
                h = PrefixHash(text.as_py()[:lead_chars])
                keys.append((*h.fingerprint(), h.n))
            columns = np.array(keys, np.int64).reshape(-1, 3).T
            if known is None:
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), *b.columns], ["lead_a", "lead_b", "lead_n", "doc_id", "text"])
                continue
            lead, hit = known.find(*columns)
            ok = pa.array(hit)
            yield pa.RecordBatch.from_arrays([pa.array(lead[hit]), *(c.filter(ok) for c in b.columns)], ["lead_doc", "doc_id", "text"])

    rows = shared.select("lead_a", "lead_b", "lead_n", "lead_doc").limit(most + 1)
    if rows.count() > most:
        sent = None
        keyed = texts.mapInArrow(run, "lead_a long, lead_b long, lead_n long, doc_id long, text string")
        return keyed.join(shared, ["lead_a", "lead_b", "lead_n"]).select("lead_doc", "doc_id", "text")
    table = rows.toArrow()
    sent = docs.sparkSession.sparkContext.broadcast(LeadTable(*(np.asarray(table.column(i).to_numpy(), np.int64) for i in range(4))))
    return texts.mapInArrow(run, "lead_doc long, doc_id long, text string")


def bucket_texts(docs: DataFrame, lead_chars: int, most_sent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Hashes of all rows, the buckets, and the texts of the buckets of more than one document, each written out."""
    narrow = materialize(fingerprint_rows(docs, lead_chars).withColumn("lead_n", F.least("n", F.lit(lead_chars))), "fingerprints")
    lead = (
        narrow.where("doc_id is not null and n is not null")
        .groupBy("lead_a", "lead_b", "lead_n")
        .agg(F.min("doc_id").alias("lead_doc"), F.count("*").alias("members"))
    )
    lead = materialize(lead, "fingerprint-leads")
    held = materialize(texts_of_shared(docs, lead.where("members > 1"), lead_chars, most_sent), "fingerprint-texts")
    return narrow, lead, held


def document_fingerprints(docs: DataFrame, lead_chars: int = LEAD_CHARS, most_sent: int = MAX_SENT_LEADS) -> DataFrame:
    """(doc_id, n_chars, fp_a, fp_b, lead_doc, common) for every row of docs.

    fp_a and fp_b are the prefix sums over the whole text: sum of code point * base**i, modulo two primes. Documents
    whose first lead_chars characters (or whole shorter texts) have one hash form a bucket; lead_doc is the bucket's
    smallest doc_id and common how many characters the text shares with that document's text from the start on
    (longest common extension by binary search on the prefix arrays, characters compared at the end; with its own
    text the whole length). If rows repeat lead_doc, its smallest text is compared. A null text has nulls in all
    but doc_id; an empty one has hashes 0. Null doc_ids are in no bucket: lead_doc and common are null. Only doc_id and
    text are read.

    The hashes are a narrow pass; buckets of more than one document are found from narrow rows; of such buckets alone
    the texts are shuffled, to the bucket's first text, in a join whose large partitions can be split."""
    narrow, lead, held = bucket_texts(docs, lead_chars, most_sent)
    firsts = held.where("doc_id = lead_doc").groupBy("lead_doc").agg(F.min("text").alias("first_text"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, first = None, None
        for b in batches:
            out = []
            for d, text, other in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                h, other = PrefixHash(text.as_py()), other.as_py()
                if other != last:
                    last, first = other, PrefixHash(other)
                out.append((d, h.n, *h.fingerprint(), first.extension(0, h, 0)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in (zip(*out) if out else [()] * 5)], ["doc_id", "n", "fp_a", "fp_b", "common"]
            )

    common = (
        held.join(firsts, "lead_doc")
        .select("doc_id", "text", "first_text")
        .mapInArrow(compare, "doc_id long, n long, fp_a long, fp_b long, common long")
        .distinct()
    )
    tagged = narrow.join(lead, ["lead_a", "lead_b", "lead_n"], "left").join(common, ["doc_id", "n", "fp_a", "fp_b"], "left")
    in_bucket = F.col("doc_id").isNotNull()
    return tagged.select(
        "doc_id",
        F.col("n").alias("n_chars"),
        "fp_a",
        "fp_b",
        F.when(in_bucket, F.col("lead_doc")).alias("lead_doc"),
        F.when(in_bucket & F.col("lead_doc").isNotNull(), F.coalesce("common", "n")).alias("common"),
    )


def longest_extensions(docs: DataFrame, lead_chars: int = LEAD_CHARS, most_sent: int = MAX_SENT_LEADS) -> DataFrame:
    """(doc_id, n_chars, lead_doc, longest) for every member of a bucket of several documents (see document_fingerprints).

    longest is how many characters the text shares from the start on with that other member of the bucket with which it
    shares most. In the order of the texts this is one of the two neighbours, so each is compared with these alone.
    Rows that repeat wholly are one member; rows of one doc_id with different texts are members of their own. Documents
    whose first lead_chars characters differ, if only by an edit there, are never compared.

    The texts are sorted by range, so a large bucket is split over tasks; the first and last text of every task then
    meet their neighbours of other tasks."""
    held = bucket_texts(docs, lead_chars, most_sent)[2].distinct()
    by = ["lead_doc", "text", "doc_id"]
    names = ["lead_doc", "doc_id", "n_chars", "longest", "nf_task", "nf_text"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string()]

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, last, hashed, count = TaskContext.get().partitionId(), None, None, 0  # last: the row before, not yet sent
        for b in batches:
            out = []
            for lead, d, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                text = text.as_py()
                h, shared = PrefixHash(text), 0
                if last is not None:
                    if last[0] == lead:
                        shared = hashed.extension(0, h, 0)
                        last[3] = max(last[3], shared)
                    if count > 1:
                        last[5] = None
                    out.append(last)
                last, hashed, count = [lead, d, h.n, shared, task, text], h, count + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 6, kinds)], names)
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(last, kinds)], names)

    def at_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, own, out = b.column(3), b.column(2).to_pylist(), []
            for i, most in enumerate(own):
                h = PrefixHash(text[i].as_py())
                others = [c[i].as_py() for c in (b.column(4), b.column(5))]
                out.append(max([most, *(h.extension(0, PrefixHash(o), 0) for o in others if o is not None)]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(6), pa.array(out, pa.int64())], ["doc_id", "n_chars", "lead_doc", "longest"])

    # ranges by a short stretch after the lead: it keeps the order of the texts, and the driver samples no whole texts
    beyond = F.substring("text", lead_chars + 1, lead_chars)
    placed = held.select("lead_doc", "doc_id", "text").repartitionByRange("lead_doc", beyond).sortWithinPartitions(*by)
    found = materialize(placed.mapInArrow(neighbours, "lead_doc long, doc_id long, n_chars long, longest long, nf_task int, nf_text string"), "fingerprint-neighbours")
    w = Window.orderBy("nf_task", "lead_doc", "nf_text", "doc_id")  # two rows a task
    same = lambda step: F.when(step("lead_doc").over(w) == F.col("lead_doc"), step("nf_text").over(w))
    edges = found.where("nf_text is not null").withColumns({"before": same(F.lag), "after": same(F.lead)})
    edges = edges.select("doc_id", "n_chars", "longest", "nf_text", "before", "after", "lead_doc")
    return found.where("nf_text is null").select("doc_id", "n_chars", "lead_doc", "longest").unionByName(
        edges.mapInArrow(at_edges, "doc_id long, n_chars long, lead_doc long, longest long")
    )


ORACLE = f"""
WITH d AS (
  SELECT doc_id, text, string_split(text, '') AS c,
         list_transform(string_split(text, ''), lambda x: unicode(x)::BIGINT) AS u
  FROM documents),
h AS (
  SELECT doc_id, c, len(c) AS n,
    list_reduce(list_concat([0::BIGINT], list_reverse(u)), lambda s, x: (s * {BASES[0]} + x) % {MODULI[0]}) AS fp_a,
    list_reduce(list_concat([0::BIGINT], list_reverse(u)), lambda s, x: (s * {BASES[1]} + x) % {MODULI[1]}) AS fp_b,
    array_to_string(c[1:{LEAD_CHARS}], '') AS lead
  FROM d),
l AS (SELECT *, min(doc_id) OVER (PARTITION BY lead) AS lead_doc FROM h)
SELECT a.doc_id, a.n::BIGINT AS n_chars, a.fp_a, a.fp_b, a.lead_doc,
  CASE WHEN a.doc_id = a.lead_doc THEN a.n
       ELSE coalesce(list_position(list_transform(range(1, least(a.n, b.n) + 1), lambda i: a.c[i] <> b.c[i]), true) - 1,
                     least(a.n, b.n)) END::BIGINT AS common
FROM l a JOIN h b ON b.doc_id = a.lead_doc
"""
