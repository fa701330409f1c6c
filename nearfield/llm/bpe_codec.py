"""BPE encoding with content-defined chunks, and decoding."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from nearfield.llm.textscan import string_spans
from nearfield.llm.token_counts import RANKS_PATH, SPLIT, read_ranks

CHUNK_BITS = 10  # a cut after every 1024 bytes on average
MIN_CHUNK = 128
MAX_CHUNK = 1 << 14
#: Bytes of chunk text whose encodings a worker keeps; beyond it the table starts anew (costs time, changes nothing).
KEPT_BYTES = 16 << 20
#: The encoder's splitter looks back over a run of blanks and gives up at about a million; runs from this length on are
#: split off, where it would split them, before it sees them.
LONG_BLANKS = 1 << 16
_GEAR = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)
_codecs: dict[str, ChunkCodec] = {}


def rolling_hash(raw: np.ndarray) -> np.ndarray:
    """Gear hash at every byte: sum of gear[byte] << age over the last 32 bytes, modulo 2**32, built by doubling."""
    h = _GEAR[raw]
    for age in (1, 2, 4, 8, 16):
        if len(h) > age:
            h[age:] += h[:-age] << np.uint32(age)
    return h


def cut_points(raw: np.ndarray, bits: int = CHUNK_BITS, least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> list[int]:
    """Chunk boundaries 0 < c < len(raw) chosen by content, at starts of UTF-8 characters."""
    n = len(raw)
    found = np.flatnonzero((rolling_hash(raw) >> np.uint32(32 - bits)) == 0) + 1
    cuts, last = [], 0

    def cut(c: int) -> None:
        nonlocal last
        while c < n and raw[c] & 0xC0 == 0x80:
            c += 1
        if last < c < n:
            cuts.append(c)
            last = c

    for c in [*found.tolist(), n]:
        while c - last > most:
            cut(last + most)
        if c - last >= least:
            cut(c)
    return cuts


_BLANK, _SOLID = np.zeros(256, bool), np.zeros(256, bool)
_BLANK[[10, 32]] = True
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    _SOLID[_a:_b] = True


def encode_text(coding: tiktoken.Encoding, text: str, long_blanks: int = LONG_BLANKS) -> list[int]:
    """coding.encode_ordinary(text) for texts with blank runs of any length.

    A run that ends the text is one piece. Of any other all but the last blank are one: the last goes with what follows
    it, as the splitter leaves it."""
    if len(text) < long_blanks:
        return coding.encode_ordinary(text)
    out: list[int] = []
    done = 0
    for m in regex.finditer(rf"\s{{{long_blanks},}}+", text):
        stop = m.end() - (m.end() < len(text))
        out += coding.encode_ordinary(text[done : m.start()])
        out += coding._encode_single_piece(text[m.start() : stop].encode())
        done = stop
    return out + coding.encode_ordinary(text[done:])


class ChunkCodec:
    """Encodes a text as its chunks' encodings, each made once while it is kept, with repaired joins.

    A place where a blank follows an ASCII letter or digit is a boundary of pieces in every text that holds it: no
    piece goes on from a letter to a blank. Around a join the text from the last such place before it to the
    first after it is encoded anew, with one more such stretch on either side as a guard; the chunk's own
    tokens must be whole up to these places and the guards' tokens agree with the chunks' own, else the stretch
    grows. So the result is exactly that of encoding the text at once."""

    def __init__(self, ranks: dict[bytes, int], kept_bytes: int = KEPT_BYTES):
        self.coding = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.spelled = {i: b for b, i in ranks.items()}
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        for b, i in ranks.items():
            self.size[i] = len(b)
        self.kept: dict[bytes, np.ndarray] = {}
        self.kept_bytes, self.room = kept_bytes, kept_bytes
        self.encoded = self.reused = self.repaired = 0

    def _encode(self, part: bytes) -> np.ndarray:
        return np.array(encode_text(self.coding, part.decode("utf-8", "surrogatepass")), np.int32)

    def chunk(self, part: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of the chunk, and where they start and end: n+1 byte places."""
        ids = self.kept.get(part)
        if ids is None:
            self.encoded += 1
            ids = self._encode(part)
            if self.room < len(part):
                self.kept.clear()
                self.room = self.kept_bytes
            self.kept[part] = ids
            self.room -= len(part)
        else:
            self.reused += 1
        places = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(self.size[ids], out=places[1:])
        return ids, places

    def encode(self, raw: np.ndarray, cuts: list[int] | None = None) -> np.ndarray:
        """Token ids of the UTF-8 bytes raw."""
        data, n = raw.tobytes(), len(raw)
        cuts = cut_points(raw) if cuts is None else cuts
        if not cuts:
            return self.chunk(data)[0] if n else np.zeros(0, np.int32)
        edges = [0, *cuts, n]
        chunks = [self.chunk(data[a:b]) for a, b in zip(edges, edges[1:])]
        safe = np.flatnonzero(_BLANK[raw[1:]] & _SOLID[raw[:-1]]) + 1
        safe = np.r_[0, safe, n]
        out: list[np.ndarray] = []
        done = 0  # bytes whose tokens are out, a safe place
        k = 0  # chunk that holds `done`
        while True:
            # tokens of chunk k from `done` up to the stretch around its right edge
            if k == len(cuts):
                ids, places = chunks[k]
                out.append(ids[np.searchsorted(places, done - edges[k]) :])
                return np.concatenate(out)
            join = edges[k + 1]
            left, right = np.searchsorted(safe, join, "right") - 1, np.searchsorted(safe, join, "left")
            while True:
                a, b = max(int(safe[left]), done), int(safe[right])
                stretch = self._stretch(data, chunks, edges, safe, done, k, left, right)
                if stretch is not None:
                    break
                left, right = max(left - 1, 0), min(right + 1, len(safe) - 1)
            own, anew, k_next = stretch
            out += [own, anew]
            self.repaired += 1
            done, k = b, k_next
            if done == n:
                return np.concatenate(out)

    def _stretch(self, data, chunks, edges, safe, done, k, left, right):
        """Own tokens of chunk k from `done` to the stretch, the stretch's tokens anew, and the chunk where it ends;
        None if they don't agree with the chunks' own around it."""
        a, b = max(int(safe[left]), done), int(safe[right])
        last = k + 1
        while last < len(chunks) - 1 and edges[last + 1] <= b:
            last += 1
        if a < edges[k]:
            a = done
        ids, places = chunks[k]
        i, j = (int(np.searchsorted(places, x - edges[k])) for x in (done, a))
        if done < edges[k] or places[i] != done - edges[k] or places[j] != a - edges[k]:
            if a != done:
                return None
            i = j = 0
        own = ids[i:j]
        # guards: the stretches next to it, as far as they lie in the chunks themselves
        before = max(int(safe[max(left - 1, 0)]), done, edges[k])
        before = before if before < a else a
        after = int(safe[min(right + 1, len(safe) - 1)])
        after = after if last < len(chunks) and after < edges[last + 1] else b
        anew = self._encode(data[before:after])
        at = np.zeros(len(anew) + 1, np.int64)
        np.cumsum(self.size[anew], out=at[1:])
        x, y = int(np.searchsorted(at, a - before)), int(np.searchsorted(at, b - before))
        if at[x] != a - before or at[y] != b - before:
            return None
        if before < a:
            g = int(np.searchsorted(places, before - edges[k]))
            if places[g] != before - edges[k] or not np.array_equal(anew[:x], ids[g:j]):
                return None
        if after > b:
            ids2, places2 = chunks[last]
            g, h = (int(np.searchsorted(places2, z - edges[last])) for z in (b, after))
            if places2[g] != b - edges[last] or places2[h] != after - edges[last] or not np.array_equal(anew[y:], ids2[g:h]):
                return None
        return own, anew[x:y], last

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.spelled.__getitem__, ids.tolist()))


def encode_documents(docs: DataFrame, ranks_path: str = RANKS_PATH) -> DataFrame:
    """(doc_id, token_ids, n_tokens, round_trip) for every row of docs.

    token_ids are exactly those of encoding the whole text at once; round_trip tells whether decoding them gives the
    text's bytes again (always true; computed for every row). A null text has nulls; an empty one an
    empty list and true. Rows that repeat and null doc_ids are encoded like any. Only doc_id and text are read. Texts of any
    length are encoded whole, runs of millions of blanks, letters or signs included.

    Narrow, no shuffle: chunks that documents share are encoded once by each Python worker while it keeps them, which
    holds over the tasks that a worker runs. Sending every chunk's tokens to its documents instead would shuffle
    more bytes than the corpus has."""
    sent, key = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path)), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _codecs:
            _codecs.clear()
            _codecs[key] = ChunkCodec(sent.value)
        codec = _codecs[key]
        for b in batches:
            raw, starts, ends = string_spans(b.column(1))
            null = np.asarray(b.column(1).is_null())
            lo, total, lists, same = 0, 0, [], []

            def piece(lo: int, hi: int) -> pa.RecordBatch:
                sizes = np.array([len(x) for x in lists], np.int64)
                places = np.zeros(len(lists) + 1, np.int32)
                np.cumsum(sizes, out=places[1:])
                gone = null[lo:hi]
                ids = pa.ListArray.from_arrays(
                    pa.array(places, pa.int32()), pa.array(np.concatenate(lists), pa.int32()),
                    mask=pa.array(gone) if gone.any() else None,
                )
                return pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), ids, pa.array(sizes, pa.int64(), mask=gone), pa.array(same, pa.bool_(), mask=gone)],
                    ["doc_id", "token_ids", "n_tokens", "round_trip"],
                )

            for i in range(len(starts)):
                text = raw[starts[i] : ends[i]]
                ids = codec.encode(text)
                lists.append(ids)
                same.append(codec.decode(ids) == text.tobytes())
                total += len(ids)
                if total > 1 << 20:
                    yield piece(lo, i + 1)
                    lo, total, lists, same = i + 1, 0, [], []
            if lists:
                yield piece(lo, len(starts))

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, token_ids array<int>, n_tokens long, round_trip boolean"
    )
