"""Secret scans by probabilistic automata inferred from labelled credentials."""

from __future__ import annotations

import heapq
import math
import random
import re
import string
import uuid
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Runs of characters that credentials are made of; dots only between longer parts, padding at the end. And the headers of
#: armoured keys. Of fewer than 16 characters too little can be told by their format.
CANDIDATE = re.compile(r"-{5}[A-Z][A-Z0-9 ]{6,60}-{5}|[A-Za-z0-9_\-+/]{16,}(?:\.[A-Za-z0-9_\-+/]{8,})*={0,2}")
#: Within a run a credential begins at its start or after one of these, and ends at its end or before one.
SEPARATOR = re.compile(r"[_\-+/.=]+")
LEAST = 16
#: Parts of a run have no longest length.
LONGEST_PART = math.inf
#: In runs of up to so many characters all parts are scored; in longer ones the best of each start is searched for, with the same result.
LISTED = 512
#: Bits by which a credential must be likelier than anything else.
MARGIN_BITS = 12.0
#: What the label before a candidate can count at most, either way.
LABEL_BITS = 16.0
ALPHA = 0.05
#: The word before a candidate, as in `name = "..."`, `name: ...`, `name ...` or name_...
LABEL = re.compile(r"""([A-Za-z][A-Za-z0-9_\-]{0,40})["']?\s{0,3}(?:(?:[:=]{1,2}|=>)\s{0,3})?["'`]?$""")
_LABEL_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_SYMBOLS = 80  # for smoothing: how many characters there may be
_scanners: dict[str, Scanner] = {}


def labelled_examples(each: int = 300, seed: int = 7) -> list[tuple[str, bool, str]]:
    """(format, credential, string): examples in publicly documented formats, and of what is no credential. Seeded."""
    r = random.Random(seed)
    low, up, dig = string.ascii_lowercase, string.ascii_uppercase, string.digits
    b62, b64url, hexa = low + up + dig, low + up + dig + "-_", dig + "abcdef"
    pick = lambda alphabet, n: "".join(r.choices(alphabet, k=n))
    letters = "eeeeeeeeeeeetttttttttaaaaaaaaooooooooiiiiiiinnnnnnnssssssshhhhhhrrrrrrddddlllluuucccmmmwwffggyyppbbvkjxqz"
    word = lambda a, b: pick(letters, r.randint(a, b))
    b64json = lambda n: "eyJ" + pick(b64url, n)
    makers = {
        ("hex_token", True): lambda: pick(hexa, r.choice((32, 40, 40, 64))),
        ("access_key_id", True): lambda: r.choice(("AKIA", "ASIA")) + pick(up + "234567", 16),
        ("secret_key", True): lambda: pick(b62 + "+/", 40),
        ("prefixed_token", True): lambda: r.choice(("ghp_", "gho_", "ghs_")) + pick(b62, 36),
        ("api_key", True): lambda: "AIza" + pick(b64url, 35),
        ("payment_key", True): lambda: r.choice(("sk_live_", "rk_live_")) + pick(b62, 24),
        ("chat_token", True): lambda: f"xox{r.choice('bp')}-{pick(dig, 12)}-{pick(dig, 12)}-{pick(b62, 24)}",
        ("web_token", True): lambda: f"{b64json(r.randint(17, 33))}.{b64json(r.randint(40, 400))}.{pick(b64url, 43)}",
        ("private_key", True): lambda: f"-----BEGIN {r.choice(('', 'RSA ', 'EC ', 'DSA ', 'OPENSSH ', 'ENCRYPTED '))}PRIVATE KEY-----",
        ("armour", False): lambda: f"-----{r.choice(('BEGIN', 'END'))} {r.choice(('CERTIFICATE', 'PUBLIC KEY', 'RSA PUBLIC KEY', 'CERTIFICATE REQUEST', 'PGP MESSAGE', 'PGP SIGNATURE'))}-----",
        ("armour_end", False): lambda: f"-----END {r.choice(('', 'RSA ', 'EC ', 'DSA ', 'OPENSSH ', 'ENCRYPTED '))}PRIVATE KEY-----",
        ("digest", False): lambda: pick(hexa, r.choice((32, 40, 40, 64))),
        ("upper_digest", False): lambda: pick(dig + "ABCDEF", r.choice((32, 40, 64))),
        ("integrity", False): lambda: r.choice((lambda: "sha256-" + pick(b62 + "+/", 43) + "=", lambda: "sha384-" + pick(b62 + "+/", 64)))(),
        ("record_id", False): lambda: pick(hexa, 24),
        ("sortable_id", False): lambda: pick(dig + "ABCDEFGHJKMNPQRSTVWXYZ", 26),
        ("encoded_data", False): lambda: pick(b62 + "+/", 4 * r.randint(15, 120) - 2) + "==",
        ("encoded_url_data", False): lambda: pick(b64url, 4 * r.randint(15, 120) - 2),
        ("word", False): lambda: (w := word(16, 40)).capitalize() if r.random() < 0.2 else word(16, 40),
        ("upper_word", False): lambda: word(16, 40).upper(),
        ("number", False): lambda: pick(dig, r.randint(16, 20)),
        ("joined_words", False): lambda: r.choice("-_/").join(word(2, 10) for _ in range(r.choice((3, 4, 5, 6, 7, 20, 60)))),
        ("host", False): lambda: word(16, 20) + "." + word(8, 12),
        ("uuid", False): lambda: "-".join(pick(hexa, n) for n in (8, 4, 4, 4, 12)),
        ("date_path", False): lambda: f"{r.randint(1990, 2030)}/{r.randint(10, 12)}/{r.randint(10, 28)}/{word(6, 20)}",
        ("rule", False): lambda: r.choice("-_=+/") * r.randint(16, 80),
    }
    return [(name, secret, make()) for (name, secret), make in makers.items() for _ in range(each)]


def labelled_labels(each: int = 300) -> list[tuple[bool, str]]:
    """(credential, label): names under which credentials, and other strings of their formats, are written."""
    secret = "token secret key password passwd auth bearer credential api_key access_key secret_key access_token auth_token client_secret private_key session_token"
    other = "sha md5 commit checksum hash digest id uuid guid revision etag integrity fingerprint blob tree parent build version serial order invoice trace_id request_id span_id ref file"
    return [(kind, label) for kind, names in ((True, secret), (False, other)) for label in names.split() for _ in range(each)]


class Automaton:
    """A probabilistic automaton by ALERGIA: the prefix tree of the examples, in which states whose stopping and
    next-character frequencies don't differ by more than Hoeffding's bound, nor those of what follows, are one."""

    def __init__(self, examples: list[str], alpha: float = ALPHA):
        self.n, self.f, self.to = [0], [0], [{}]
        for text in sorted(examples):
            at = 0
            self.n[0] += 1
            for c in text:
                at = self._child(at, c)
                self.n[at] += 1
            self.f[at] += 1
        self.total = self.n[0]
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge()
        self._keep_reached()
        lengths = Counter(map(len, examples))
        self.length_bits = {k: -math.log2(v / (len(examples) + 1)) for k, v in lengths.items()}
        self.other_length = math.log2((len(examples) + 1) * 64)
        self.longest_example = max(lengths, default=0)
        # log2 of the smoothed probabilities
        self.bits = []
        self.rare, self.stop = [], []
        for s in range(len(self.n)):
            d = self.n[s] + 0.02 * (_SYMBOLS + 1)
            self.bits.append({c: (-math.log2((k + 0.02) / d), t) for c, (k, t) in self.arcs[s].items()})
            self.rare.append(-math.log2(0.02 / d))
            self.stop.append(-math.log2((self.f[s] + 0.02) / d))

    def _child(self, at: int, c: str) -> int:
        t = self.to[at].get(c)
        if t is None:
            t = self.to[at][c] = len(self.n)
            self.n.append(0)
            self.f.append(0)
            self.to.append({})
        return t

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) > self.bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _merge(self) -> None:
        # counts of arcs are kept apart from their targets: folding a state moves both
        self.arcs = [{c: [self.n[t], t] for c, t in m.items()} for m in self.to]
        red, seen = [0], {0}
        while True:
            blue = next(((p, c, a[1]) for p in red for c, a in sorted(self.arcs[p].items()) if a[1] not in seen), None)
            if blue is None:
                break
            p, c, b = blue
            # the state before it first, then the latest: loops before far states
            for r in [p, *[x for x in reversed(red) if x != p]]:
                if self._compatible(r, b):
                    self.arcs[p][c][1] = r
                    self._fold(r, b)
                    break
            else:
                red.append(b)
                seen.add(b)

    def _keep_reached(self) -> None:
        """Forgets the states that were folded into others."""
        names, todo = {0: 0}, [0]
        while todo:
            for _, t in self.arcs[todo.pop()].values():
                if t not in names:
                    names[t] = len(names)
                    todo.append(t)
        self.n, self.f = [self.n[s] for s in names], [self.f[s] for s in names]
        self.arcs = [{c: [k, names[t]] for c, (k, t) in self.arcs[s].items()} for s in names]
        self.states = len(names)
        del self.to

    def _compatible(self, r: int, b: int) -> bool:
        stack = [(r, b)]
        while stack:
            x, y = stack.pop()
            if self._differ(self.f[x], self.n[x], self.f[y], self.n[y]):
                return False
            for c in self.arcs[x].keys() | self.arcs[y].keys():
                i, j = self.arcs[x].get(c), self.arcs[y].get(c)
                if self._differ(i[0] if i else 0, self.n[x], j[0] if j else 0, self.n[y]):
                    return False
                if i and j:
                    stack.append((i[1], j[1]))
        return True

    def _fold(self, r: int, b: int) -> None:
        stack = [(r, b)]
        while stack:
            x, y = stack.pop()
            self.n[x] += self.n[y]
            self.f[x] += self.f[y]
            for c, (k, t) in list(self.arcs[y].items()):
                have = self.arcs[x].get(c)
                if have is None:
                    self.arcs[x][c] = [k, t]
                else:
                    have[0] += k
                    stack.append((have[1], t))

    def cost(self, text: str, limit: float) -> float:
        """Bits of the text, its length included; infinite once they are over limit."""
        at, total = 0, self.length_bits.get(len(text), self.other_length)
        bits = self.bits
        for c in text:
            arc = bits[at].get(c)
            if arc is None:
                total += self.rare[at]
            else:
                total += arc[0]
                at = arc[1]
            if total > limit:
                return math.inf
        return total + self.stop[at]

    def walk(self, text: str, at: int = 0, total: float = 0.0) -> tuple[int, float]:
        """The state after the text from state `at`, and total with the bits of its characters."""
        bits = self.bits
        for c in text:
            arc = bits[at].get(c)
            if arc is None:
                total += self.rare[at]
            else:
                total += arc[0]
                at = arc[1]
        return at, total

    def costs(self, text: str, ends: list[int]) -> list[float]:
        """cost() of the beginnings of text of these lengths, which rise."""
        at, total, i, out = 0, 0.0, 0, []
        for n in ends:
            at, total = self.walk(text[i:n], at, total)
            i = n
            out.append(total + self.stop[at] + self.length_bits.get(n, self.other_length))
        return out


class Table:
    """Automata side by side, to take all their states a character back at once. Runs are ASCII."""

    def __init__(self, models: list[Automaton]):
        first = [0]
        for m in models:
            first.append(first[-1] + m.states)
        self.roots = first[:-1]
        self.stop = np.array([x for m in models for x in m.stop])
        bits = np.tile(np.array([x for m in models for x in m.rare]), (128, 1))
        to = np.tile(np.arange(first[-1]), (128, 1))
        for m, f in zip(models, first):
            for s, arcs in enumerate(m.bits):
                for c, (x, t) in arcs.items():
                    if c.isascii():
                        bits[ord(c), f + s], to[ord(c), f + s] = x, f + t
        self.bits, self.to = list(bits), list(to)


class Back:
    """A walk back through a run from hi: of every state at the place reached the fewest bits, and where they end."""

    def __init__(self, table: Table, run: str, hi: int):
        self.table, self.run, self.at = table, run.encode(), hi
        self.v, self.end = np.full(len(table.stop), math.inf), np.full(len(table.stop), hi)

    def to(self, place: int) -> None:
        for c in self.run[place : self.at][::-1]:
            to = self.table.to[c]
            self.v, self.end = self.table.bits[c] + self.v.take(to), self.end.take(to)
        self.at = place

    def stop_here(self, rest: float) -> None:
        """A part may end at the place reached, with so many bits for the rest of the run; ties: the later end."""
        x = self.table.stop + rest
        self.end = np.where(x < self.v, self.at, self.end)
        self.v = np.minimum(x, self.v)


class Best(dict):
    """Of each start the (bits, end, format) of the fewest bits; ties: the later end, then the first format by name."""

    def offer(self, a: int, bits: float, b: int, name: str) -> None:
        if bits < math.inf and (a not in self or (bits, -b, name) < (self[a][0], -self[a][1], self[a][2])):
            self[a] = (bits, b, name)


class Labels:
    """How much more likely the words of a label are before a credential than before anything else, in bits."""

    def __init__(self, examples: list[tuple[bool, str]]):
        count = {True: Counter(), False: Counter()}
        for secret, label in examples:
            count[secret].update(label_words(label))
        total = {k: sum(c.values()) + 1 for k, c in count.items()}
        self.bits = {
            w: math.log2((count[True][w] + 0.02) / total[True]) - math.log2((count[False][w] + 0.02) / total[False]) for w in count[True] | count[False]
        }

    def evidence(self, before: str) -> float:
        """Of the label that ends the text before a candidate; 0 without one, or with one of unknown words."""
        m = LABEL.search(before[-64:])
        if m is None:
            return 0.0
        total = sum(self.bits.get(w, 0.0) for w in label_words(m.group(1)))
        return max(-LABEL_BITS, min(LABEL_BITS, total))


def cuts_of(run: str) -> list[tuple[int, int]]:
    """(start, end) of the separators within a run; the header of a key has none."""
    return [] if run.startswith("-----") else [m.span() for m in SEPARATOR.finditer(run)]


def places(cuts: list[tuple[int, int]], n: int) -> tuple[list[int], list[int]]:
    """Where parts of a run of n characters start, and where they end."""
    return [0, *(e for _, e in cuts if e < n)], [*(s for s, _ in cuts if s > 0), n]


def label_words(label: str) -> list[str]:
    return [w.lower() for w in _LABEL_WORD.findall(label)]


class Scanner:
    """Format likelihoods of candidates; results are kept by string up to `most`."""

    def __init__(self, examples: list[tuple[str, bool, str]], margin: float, alpha: float = ALPHA, labels: list[tuple[bool, str]] | None = None, most: int = 200_000):
        of: dict[tuple[str, bool], list[str]] = {}
        for name, secret, text in examples:
            of.setdefault((name, secret), []).append(text)
        self.models = [(name, secret, Automaton(x, alpha)) for (name, secret), x in sorted(of.items())]
        self.formats = [(name, m) for name, secret, m in self.models if secret]
        self.others = [m for _, secret, m in self.models if not secret]
        self.long = {name: 2 * m.longest_example for name, m in self.formats}
        self.format_table, self.other_table = Table([m for _, m in self.formats]), Table(self.others)
        self.labels = Labels(labelled_labels() if labels is None else labels)
        self.margin, self.most, self.kept = margin, most, {}

    def other_bits(self, text: str) -> float:
        """Of the likeliest format that is no credential. 8 bits a character explain anything; what takes more explains nothing."""
        if not text:
            return 0.0
        best = 8.0 * len(text) + 16
        for m in self.others:
            best = min(best, m.cost(text, best))
        return best

    def format_of(self, text: str, limit: float) -> tuple[float, str | None]:
        """(bits, name) of the likeliest credential format that takes fewer bits than limit; ties: the first by name. Of any length:
        a length without an example has its likelihood too."""
        best, name = limit, None
        for k, m in self.formats:
            if (x := m.cost(text, best)) < best:
                best, name = x, k
        return best, name

    def parts(self, run: str) -> list[tuple[int, int, str, float]]:
        """(start, end, format, score without a label) of the whole run and its parts that could be credentials with one."""
        if run in self.kept:
            return self.kept[run]
        least, n = self.margin - LABEL_BITS, len(run)
        other = self.other_bits(run)
        bits, name = self.format_of(run, other - least)
        found = {} if name is None else {(0, n): (name, other - bits)}
        if cuts := cuts_of(run):
            starts, ends = places(cuts, n)
            after, (whole, before) = self._after(run, ends), self._before(run, starts)
            for a, rest in zip(starts, before):
                here = [b for b in ends if b - a >= LEAST and (a, b) != (0, n)]
                best = {b: (whole - rest - after[b] - least, None) for b in here}
                for name, m in self.formats:
                    for b, x in zip(here, m.costs(run[a:], [b - a for b in here])):
                        if x < best[b][0]:
                            best[b] = (x, name)
                found |= {(a, b): (name, whole - rest - after[b] - x) for b, (x, name) in best.items() if name is not None}
        parts = [(a, b, *x) for (a, b), x in found.items()]
        if n <= 256:
            if len(self.kept) >= self.most:
                self.kept.clear()
            self.kept[run] = parts
        return parts

    def _before(self, run: str, starts: list[int]) -> tuple[float, list[float]]:
        """other_bits() of the run, and of what is before each of the starts."""
        n = len(run)
        before, whole = [8.0 * a + 16 if a else 0.0 for a in starts], 8.0 * n + 16
        for m in self.others:
            costs = m.costs(run, [*starts, n])
            before = [min(x, y) for x, y in zip(before, costs)]
            whole = min(whole, costs[-1])
        return whole, before

    def _after(self, run: str, ends: list[int]) -> dict[int, float]:
        """other_bits() of what is after each of the ends, all in one walk back through the run."""
        back, n, after = Back(self.other_table, run, len(run)), len(run), {}
        back.stop_here(0.0)
        for b in reversed(ends):
            back.to(b)
            k, x = n - b, back.v.take(self.other_table.roots).tolist()
            after[b] = min([8.0 * k + 16, *(y + m.length_bits.get(k, m.other_length) for m, y in zip(self.others, x))]) if k else 0.0
        return after

    def _near(self, run: str, a: int, ends: list[int], hi: int, waiting: dict[int, list[tuple[int, int, float, str]]]) -> Iterator[tuple[float, int, str]]:
        """(bits, end, format) of the parts from a that end by hi and are no longer than the format's longest example. For longer ones
        (start, state, bits so far and of the length, format) is put among what waits at the place reached: beyond it all lengths
        are equally likely, so that a walk back from hi tells the best end for every state."""
        i = bisect_left(ends, a + LEAST)
        for (name, m), root in zip(self.formats, self.format_table.roots):
            far = a + max(LEAST, m.longest_example)
            s, total, p = 0, 0.0, a
            for b in ends[i : bisect_right(ends, min(far, hi))]:
                s, total = m.walk(run[p:b], s, total)
                p = b
                yield total + m.stop[s] + m.length_bits.get(b - a, m.other_length), b, name
            if far < hi:
                s, total = m.walk(run[p:far], s, total)
                waiting.setdefault(far, []).append((a, root + s, total + m.other_length, name))

    def _best(self, run: str, starts: list[int], ends: list[int], after: dict[int, float], hi: int) -> dict[int, tuple[float, int, str]]:
        """Of each start (bits, end, format) of its best part that ends by hi: that of the fewest bits together with what is after it
        (ties: the longer, then the first format by name)."""
        best, waiting = Best(), {}
        for a in starts:
            for bits, b, name in self._near(run, a, ends, hi, waiting):
                best.offer(a, bits + after[b], b, name)
        if waiting:
            back = Back(self.format_table, run, hi)
            last = set(ends[bisect_left(ends, min(waiting)) : bisect_right(ends, hi)])
            for q in sorted(last | waiting.keys(), reverse=True):
                back.to(q)
                for a, s, total, name in waiting.get(q, ()):
                    best.offer(a, total + float(back.v[s]), int(back.end[s]), name)
                if q in last:
                    back.stop_here(after[q])
        return best

    def _divided(self, run: str, lo: int, hi: int) -> list[tuple[int, int, str]]:
        """(start, end, format) of the credentials that explain the part from lo to hi in the fewest bits, be it one or several; what
        is between them takes 8 bits a character."""
        cuts = [(s, e) for s, e in cuts_of(run) if lo < s and e < hi]
        starts, ends, next_start = [lo, *(e for _, e in cuts)], [*(s for s, _ in cuts), hi], dict(cuts)
        best, waiting, rest = Best(), {}, {}
        for a in starts:
            for _ in self._near(run, a, ends, hi, waiting):
                pass
        back = Back(self.format_table, run, hi)
        last, first = set(ends), set(starts)
        for q in sorted(last | first | waiting.keys(), reverse=True):
            back.to(q)
            for a, s, total, name in waiting.get(q, ()):
                best.offer(a, total + float(back.v[s]), int(back.end[s]), name)
            if q in last:
                rest[q] = 8.0 * (next_start[q] - q) + best[next_start[q]][0] if q < hi else 0.0
                back.stop_here(rest[q])
            if q in first:
                for bits, b, name in self._near(run, q, ends, hi, {}):
                    best.offer(q, bits + rest[b], b, name)
                b = ends[bisect_right(ends, q)]
                best.offer(q, 8.0 * (b - q) + rest[b], b, "")
        found, a = [], lo
        while True:
            _, b, name = best[a]
            if name:
                found.append((a, b, name))
            if b == hi:
                return found
            a = next_start[b]

    def _chosen(self, run: str, evidence: Callable[[int], float]) -> list[tuple[int, int, str, float]]:
        """(start, end, format, score) of the parts chosen, in order: always the one of the highest score that overlaps none before it."""
        taken = []
        for a, b, name, score in self.parts(run):
            score += evidence(a)
            if score >= self.margin:
                taken.append((-score, a - b, a, b, name))
        kept: list[tuple[int, int, str, float]] = []
        for score, _, a, b, name in sorted(taken):
            i = bisect_left(kept, (a,))
            if (i == 0 or kept[i - 1][1] <= a) and (i == len(kept) or kept[i][0] >= b):
                kept.insert(i, (a, b, name, -score))
        return kept

    def _chosen_of_long(self, run: str, cuts: list[tuple[int, int]], evidence: Callable[[int], float]) -> list[tuple[int, int, str, float]]:
        """_chosen() without a list of all parts: of every start only the best part that still fits is known. Once a chosen part
        lies in the way, its score is the most that a shorter one can have, and those are searched for when it is next."""
        starts, ends = places(cuts, len(run))
        after, (whole, before) = self._after(run, ends), self._before(run, starts)
        rest, label = dict(zip(starts, before)), {}
        heap: list[tuple[float, int, int, int, str]] = []
        now: dict[int, tuple[float, int, int, int, str]] = {}

        def search(some: list[int], hi: int) -> None:
            for a in some:
                now.pop(a, None)
            for a, (bits, b, name) in self._best(run, some, ends, after, hi).items():
                score = whole - rest[a] - bits
                if score + LABEL_BITS < self.margin:
                    continue
                if a not in label:
                    label[a] = evidence(a)
                if score + label[a] >= self.margin:
                    now[a] = (-(score + label[a]), a - b, a, b, name)
                    heapq.heappush(heap, now[a])

        search(starts, len(run))
        kept: list[tuple[int, int, str, float]] = []
        while heap:
            part = heapq.heappop(heap)
            score, _, a, b, name = part
            i = bisect_left(kept, (a,))
            if now.get(a) is not part or i and kept[i - 1][1] > a:
                continue
            if i < len(kept) and kept[i][0] < b:
                lo, hi = kept[i - 1][1] if i else 0, kept[i][0]
                search([x for x in starts[bisect_left(starts, lo) : bisect_left(starts, hi)] if x in now and now[x][3] > hi], hi)
            else:
                kept.insert(i, (a, b, name, -score))
        return kept

    def _one_or_several(self, run: str, part: tuple[int, int, str, float]) -> list[tuple[int, int, str, float]]:
        """The part, or those that it consists of if it is so long that there may be several and these are likelier than one."""
        a, b, name, _ = part
        several = self._divided(run, a, b) if b - a > self.long[name] else []
        return [part] if len(several) < 2 else [(*x, math.inf) for x in several]  # infinite: still to be scored

    def spans(self, text: str) -> Iterator[tuple[int, int, str, float]]:
        """(start, end, format, score) of the credentials in text, in order. Of parts of a run that overlap the one of the highest
        score is chosen (ties: the longer, then the first). A chosen part has to reach the margin between its chosen neighbours
        too: what they explain is then no reason for it. One of more than twice the length of its format's longest example may be several
        in a row; it is those if that takes fewer bits, each of which has to reach the margin by itself."""
        for m in CANDIDATE.finditer(text):
            run, s = m.group(), m.start()
            evidence = lambda a: self.labels.evidence(text[max(0, s + a - 64) : s + a])  # noqa: B023, E731
            cuts = cuts_of(run) if len(run) > LISTED else []
            kept = self._chosen_of_long(run, cuts, evidence) if cuts else self._chosen(run, evidence)
            if any(b - a > self.long[name] for a, b, name, _ in kept):
                kept = [x for k in kept for x in self._one_or_several(run, k)]
            for i, (a, b, name, score) in enumerate(kept):
                if len(kept) > 1:
                    lo, hi = kept[i - 1][1] if i else 0, kept[i + 1][0] if i + 1 < len(kept) else len(run)
                    if score == math.inf:  # one of several in a row: by itself, or the separators that it shares would tell against it
                        lo, hi = a, b
                    bits, name = self.format_of(run[a:b], math.inf)
                    score = self.other_bits(run[lo:hi]) - self.other_bits(run[lo:a]) - self.other_bits(run[b:hi]) - bits
                    score += evidence(a)
                if score >= self.margin:
                    yield s + a, s + b, name, score

    def classify(self, text: str) -> tuple[str, float] | None:
        """(format, score) of a string that is a credential as a whole and without a label, or None."""
        return next(((k, x) for a, b, k, x in self.spans(text) if (a, b) == (0, len(text))), None)


def secret_spans(
    docs: DataFrame, examples: list[tuple[str, bool, str]] | None = None, margin: float = MARGIN_BITS, labels: list[tuple[bool, str]] | None = None
) -> DataFrame:
    """(doc_id, start, end, format, score): the credentials of the texts. start and end count characters.

    Every candidate (CANDIDATE, and its parts between separators) is scored: by how many bits the likeliest credential format, with
    the rest of the run explained by other formats, is likelier than the likeliest other format for the whole run, plus
    what the label before it tells. It is a credential if the score is at least `margin`. So a string that looks like
    a digest is one only under a label such as token or key; ties between formats go to the first by name.

    examples: (format, whether it is a credential, string), labels: (whether it names credentials, label); by default
    those of labelled_examples() and labelled_labels(). A format's likelihood is that of its automaton times that of the length.
    Null and empty texts have no candidates; repeated rows give repeated spans, a null doc_id is carried along; runs and
    their parts are scored at any length. Only doc_id and text are read. Narrow: no shuffle; the
    automata are inferred once, from the bounded examples, and go to the workers. The credentials themselves are not in the result."""
    scanner = Scanner(labelled_examples() if examples is None else examples, margin, labels=labels)
    sent, key = docs.sparkSession.sparkContext.broadcast(scanner), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _scanners:
            _scanners.clear()
            _scanners[key] = sent.value
        scanner = _scanners[key]
        for b in batches:
            rows = []
            for d, text in zip(b.column(0).to_pylist(), b.column(1)):
                if text := text.as_py():
                    rows += [(d, *s) for s in scanner.spans(text)]
            c = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(x, pa.int64()) for x in c[:3]), pa.array(c[3], pa.string()), pa.array(c[4], pa.float64())],
                ["doc_id", "start", "end", "format", "score"],
            )

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, start long, end long, format string, score double"
    )
