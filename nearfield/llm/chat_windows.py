"""Chat formatting in budgeted windows."""

from __future__ import annotations

import re
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.llm.token_counts import RANKS_PATH, SPLIT, count_merges, piece_counts, read_ranks

BUDGET = 512
HISTORY = 128
#: Tokens that a turn's markers take.
TURN_OVERHEAD = 4
_ROLE = re.compile(r"[^\w-]")
_TURN = re.compile(r"<\|([\w-]*)\|>\n(.*?)\n<\|end\|>\n", re.S)
TURN = "struct<turn:long,role:string,text:string,target:int>"
SCHEMA = f"conv_id long, window int, first_turn long, last_turn long, n_tokens long, oversize boolean, turns array<{TURN}>, formatted string"


def word_count(text: Column) -> Column:
    """Tokens by white space, for tests; any other count of the text can be given instead."""
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def formatted_turn(role: str, text: str) -> str:
    """A turn between its markers. In the text every "<|" is written "<||", and in the role every character that is no letter, digit,
    "_" or "-" as "_", so no text makes a marker; turns_of() undoes the former."""
    return f"<|{_ROLE.sub('_', role)}|>\n{text.replace('<|', '<||')}\n<|end|>\n"


def turns_of(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of a formatted window."""
    return [(role, text.replace("<||", "<|")) for role, text in _TURN.findall(formatted)]


def windows_of(tokens: list[int], fixed: int, budget: int, history: int) -> list[tuple[int, int, int]]:
    """(start, fresh, end) turn spans that cover all turns once as fresh ones: turns start to fresh repeat history.

    With prefix sums of the tokens, a window takes as many fresh turns as fit beside the fixed tokens and its history, which
    is as many turns before them as fit `history`. If not one fresh turn fits, the history is shortened turn by turn;
    a turn that doesn't fit alone is a window of its own."""
    total = [0, *accumulate(tokens)]
    n, fresh, out = len(tokens), 0, []
    while fresh < n:
        start = bisect_left(total, total[fresh] - history, 0, fresh) if fresh else 0
        room = budget - fixed
        # the first start from which the next fresh turn still fits
        start = min(fresh, max(start, bisect_left(total, total[fresh + 1] - room, 0, fresh + 1)))
        end = bisect_right(total, total[start] + room, fresh, n + 1) - 1
        end = max(end, fresh + 1)
        out.append((start, fresh, end))
        fresh = end
    return out


def chat_windows(
    conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, overhead: int = TURN_OVERHEAD, count=word_count
) -> DataFrame:
    """(conv_id, window, first_turn, last_turn, n_tokens, oversize, turns, formatted) for each window of each conversation.

    Turns are ordered by (turn, role, text), nulls first. The first turn whose role is system opens every window;
    the other turns follow in turn-aligned spans of at most `budget` tokens, of which up to `history` repeat the window
    before. target is 1 for assistant turns that are fresh, 0 for all others: a repeated target is masked, so each is
    trained on once. n_tokens counts everything in the window; oversize marks a window whose one fresh turn (with the system
    turn) is over the budget: texts are never cut. first_turn and last_turn are those of the span. A null text counts as
    empty, a null role as 'unknown'; rows without a conv_id are left out; rows that repeat are turns of their own. A
    conversation with nothing but a system turn has one window with no span: its turn numbers are null. Only conv_id, turn,
    role and text are read, so other columns can't clash; they meet in one shuffle by conversation, whose turns are held in one
    task. Turns of any length are kept whole. A turn that fills the budget exactly fits. Markers in texts are escaped in
    formatted (see formatted_turn), not in turns."""
    rows = turn_rows(conversations).withColumn("tokens", (count(F.col("text")) + F.lit(overhead)).cast("long"))
    return windows(rows, budget, history)


def bpe_chat_windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, ranks_path: str = RANKS_PATH) -> DataFrame:
    """chat_windows with the tokens of byte-pair encoding: a turn counts as its formatted text with the markers, which the
    vocabulary encodes as any other text. A turn ends with a line break before the next one's "<", where every split is, so
    n_tokens is exactly the number of tokens of `formatted`. The turns are counted in a narrow pass before the shuffle."""
    return windows(with_bpe_tokens(turn_rows(conversations), ranks_path), budget, history)


def turn_rows(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of the rows with a conv_id, without nulls in role and text."""
    c = conversations
    return c.where(F.col("conv_id").isNotNull()).select(
        c["conv_id"].cast("long").alias("conv_id"),
        c["turn"].cast("long").alias("turn"),
        F.coalesce("role", F.lit("unknown")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )


def with_bpe_tokens(rows: DataFrame, ranks_path: str = RANKS_PATH) -> DataFrame:
    """turn_rows with the column tokens."""
    ranks = rows.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, split = piece_counts(key, ranks), regex.compile(SPLIT).findall
        for b in batches:
            turns = (formatted_turn(r, t) for r, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist()))
            n = [len(t.encode("utf-8", "surrogatepass")) - count_merges(t, counts, split) for t in turns]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int64())], ["conv_id", "turn", "role", "text", "tokens"])

    return rows.mapInArrow(run, "conv_id long, turn long, role string, text string, tokens long")


def windows(rows: DataFrame, budget: int, history: int) -> DataFrame:
    """The windows of turn_rows with their tokens, as in chat_windows."""
    each = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "tokens"))).alias("all"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for conv, turns in zip(b.column(0).to_pylist(), b.column(1)):
                turns = turns.as_py()
                system = next((t for t in turns if t["role"] == "system"), None)
                others = [t for t in turns if t is not system]
                fixed = system["tokens"] if system else 0
                lead = [{"turn": system["turn"], "role": "system", "text": system["text"], "target": 0}] if system else []
                tokens, targets = [t["tokens"] for t in others], [t["role"] == "assistant" for t in others]
                spans = windows_of(tokens, fixed, budget, history) or [(0, 0, 0)]
                for k, (start, fresh, end) in enumerate(spans):
                    body = lead + [
                        {"turn": t["turn"], "role": t["role"], "text": t["text"], "target": int(targets[i] and i >= fresh)}
                        for i, t in enumerate(others[start:end], start)
                    ]
                    n = fixed + sum(tokens[start:end])
                    text = "".join(formatted_turn(t["role"], t["text"]) for t in body)
                    span = others[start:end]
                    out.append((conv, k, span[0]["turn"] if span else None, span[-1]["turn"] if span else None, n, n > budget, body, text))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), turn_type, pa.string()]
            columns = list(zip(*out)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], names)

    names = ["conv_id", "window", "first_turn", "last_turn", "n_tokens", "oversize", "turns", "formatted"]
    turn_type = pa.list_(pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("target", pa.int32())]))
    return each.mapInArrow(run, SCHEMA)
