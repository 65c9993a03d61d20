"""Personal data: patterns, and spans added by a semi-Markov conditional random field over whole candidate segments."""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, table

KINDS = ("email", "ip", "card", "phone")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Longest segment, in characters and in pieces.
LONGEST, PIECES = 64, 28
#: Characters around a trigger that are labelled with it: a segment that holds the trigger reaches no farther.
AROUND = LONGEST
#: What every candidate segment has: a sign of an address, or so many digits (19 is the longest card).
SIGN, DIGITS, MOST_DIGITS = re.compile(r"@|at[\])]"), 4, 19
RUN = re.compile(r"[0-9]+")
PIECE = re.compile(r"[0-9]+|[A-Za-z]+|\s+|.", re.S)
CUES = {"email": ("mail", "contact", "write"), "ip": ("ip", "host", "addr", "server"), "card": ("card", "visa", "pay"), "phone": ("tel", "phone", "call", "fax", "mobile")}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return re.sub(r"[^0-9]", "", s)


def _valid(kind: str, s: str) -> bool:
    if kind == "ip":
        return all(len(p) <= 3 and int(p) <= 255 for p in (p.lstrip("0") or "0" for p in s.split(".")))
    if kind == "card":
        return 16 <= len(d := _digits(s)) <= 19 and luhn(d)
    if kind == "phone":
        return 8 <= len(_digits(s)) <= 15
    return True


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each @ with the longest local part before it (none of it in a match before) and a domain with a dot after it."""
    done, at = 0, text.find("@")
    while at >= 0:
        before = text[done:at]
        start = done + len(before.rstrip(LOCAL))
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
        done = m.end() if m else at + 1
        at = text.find("@", done)


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    """Four numbers with dots between them, from the left of every chain of dotted numbers."""
    for m in DOTTED.finditer(text):
        if m[0].count(".") >= 3:
            runs = [n.span() for n in RUN.finditer(text, *m.span())]
            yield from ((runs[i][0], runs[i + 3][1]) for i in range(0, len(runs) - 3, 4))


FINDERS = {
    "email": _emails,
    "ip": _addresses,
    "card": lambda text: (m.span() for m in CARD.finditer(text)),
    "phone": lambda text: (m.span() for m in PHONE.finditer(text)),
}


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Leftmost matches of each kind's form that pass its test; a match that fails is dropped whole.

    Every finder looks outwards from a sign that all its matches have, so the time is in proportion to the text."""
    return {kind: [(a, b) for a, b in FINDERS[kind](text) if _valid(kind, text[a:b])] for kind in KINDS}


def segment_features(s: str, before: str, after: str) -> np.ndarray:
    """What a whole segment looks like: its digits, separators, form and check sums, its edges, and the words before."""
    d = _digits(s)
    groups = [len(g) for g in re.findall("[0-9]+", s)]
    letters = sum(c.isalpha() for c in s)
    cue = before.lower()[-20:]
    octets = len(groups) == 4 and all(int(g) <= 255 for g in re.findall("[0-9]+", s)) if letters == 0 else False
    values = [
        1,
        13 <= len(d) <= 19,
        len(d) in (15, 16),
        len(d) >= 13 and luhn(d),
        len(d) >= 13 and not luhn(d),
        8 <= len(d) <= 15,
        len(d) in (10, 11, 12),
        len(d) < 7,
        octets and letters == 0,
        octets and s.count(".") >= 3,
        bool(re.fullmatch(r"\s*[0-9]{1,3}(\s?(?:\.|\[\.\]|\(dot\))\s?[0-9]{1,3}){3}\s*", s)),
        s[:1] == "+",
        s[:1] == "(" and ")" in s,
        groups[-3:] == [3, 3, 4],
        groups == [4, 4, 4, 4] or groups == [4, 6, 5],
        len(groups) >= 3,
        "-" in s or " " in s,
        "@" in s and letters > 0,
        bool(re.fullmatch(r"[\w.+-]+\s?(?:@|\(at\)|\[at\])\s?[\w-]+(?:\s?(?:\.|\(dot\)|\[dot\])\s?[A-Za-z][\w-]*)+", s)),
        "at]" in s or "at)" in s,
        letters > 0 and "@" not in s and "at]" not in s and "at)" not in s,
        not s[:1].isalnum() and s[:1] not in "+(",
        not s[-1:].isalnum(),
        before[-1:].isalnum() or before[-1:] in "._+-@/=",
        after[:1].isalnum() or after[:1] in "@-/" or bool(re.match(r"[.][0-9A-Za-z]|[ ][0-9]", after)),
        *(any(c in cue for c in CUES[k]) for k in KINDS),
        len(s) > 40,
        bool(re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}.*|[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{2,4}", s)),
        s[:1].isspace() or s[-1:].isspace(),
    ]
    return np.array(values, float)


def candidates(text: str, taken: tuple[tuple[int, int], ...] = ()) -> tuple[list[int], list[tuple[int, int, np.ndarray]]]:
    """(edges, segments) of a stretch: piece edges, and (first edge, last edge, features) of each segment that could be one
    and touches none of the spans that are taken."""
    edges = [0, *(m.end() for m in PIECE.finditer(text))]
    free = np.ones(len(text), bool)
    for x, y in taken:
        free[max(0, x) : max(0, y)] = False
    out = []
    for i in range(len(edges) - 1):
        a = edges[i]
        if not free[a] or not (text[a].isalnum() or text[a] in "+("):
            continue
        for j in range(i + 1, min(i + PIECES, len(edges) - 1) + 1):
            b = edges[j]
            if b - a > LONGEST or text[b - 1] in "\n\r" or not free[edges[j - 1]] or not free[b - 1]:
                break
            own = text[a:b]
            if own.count("@") > 1:
                break
            digits = sum("0" <= c <= "9" for c in own)
            if text[b - 1].isalnum() and (MOST_DIGITS >= digits >= DIGITS or "@" in own or "at]" in own or "at)" in own):
                out.append((i, j, segment_features(own, text[max(0, a - 24) : a], text[b : b + 3])))
    return edges, out


#: The label of a piece outside; kinds have the numbers of their places in KINDS.
OUT = len(KINDS)


class SegmentModel:
    """A semi-Markov CRF: a stretch is cut into single pieces outside and whole segments of a kind.

    A segment scores its kind's weights times its features, and each change from one label to the next (an outside piece is
    a label too, and comes first) scores its transition weight. Segments are of bounded length, so sums over all
    segmentations, and the best one, take time in proportion to the stretch."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray):
        self.weights, self.moves = weights, moves

    def spans(self, text: str, taken: tuple[tuple[int, int], ...] = ()) -> list[tuple[str, int, int]]:
        """The best segmentation's entities: boundaries and kinds chosen together by dynamic programming."""
        edges, segments = candidates(text, taken)
        if not segments:
            return []
        scores = np.stack([s[2] for s in segments]) @ self.weights.T
        ends: dict[int, list[int]] = {}
        for n, (_, j, _) in enumerate(segments):
            ends.setdefault(j, []).append(n)
        best = np.full((len(edges), OUT + 1), -np.inf)
        best[0, OUT] = 0
        back: list[dict] = [{} for _ in edges]
        for j in range(1, len(edges)):
            to = best[j - 1] + self.moves[:, OUT]
            p = int(to.argmax())
            best[j, OUT], back[j][OUT] = to[p], (j - 1, p)
            for n in ends.get(j, ()):
                i = segments[n][0]
                by = best[i][:, None] + self.moves[:, :OUT]
                p = by.argmax(0)
                own = by[p, range(OUT)] + scores[n]
                for k in np.flatnonzero(own > best[j, :OUT]).tolist():
                    best[j, k], back[j][k] = own[k], (i, int(p[k]))
        out, j, k = [], len(edges) - 1, int(best[-1].argmax())
        while j > 0:
            i, p = back[j][k]
            if k != OUT:
                out.append((KINDS[k], edges[i], edges[j]))
            j, k = i, p
        return out[::-1]

    @staticmethod
    def fitted(examples: list[tuple[str, list[tuple[str, int, int]]]], rounds: int = 60, rate: float = 0.5, ridge: float = 1e-3) -> SegmentModel:
        """Conditional likelihood by gradient steps: observed features and moves of the true segmentation less their
        expectation, which forward and backward sums over all segmentations give."""
        p = Prepared.of(examples)
        weights, moves = np.zeros((OUT, p.features.shape[1])), np.zeros((OUT + 1, OUT + 1))
        speed = [np.zeros_like(weights), np.zeros_like(moves)]
        for _ in range(rounds):
            segments, changes = p.expected(np.exp(np.clip(p.features @ weights.T, -25, 25)), np.exp(np.clip(moves, -9, 9)))
            total = ((p.observed - segments).T @ p.features, p.moves - changes)
            for s, t, w in zip(speed, total, (weights, moves), strict=True):
                s *= 0.8
                s += rate * (t / len(p.last) - ridge * w)
            weights, moves = weights + speed[0], moves + speed[1]
        return SegmentModel(weights, moves)


@dataclass
class Prepared:
    """Examples as arrays: each one's last edge; each segment's example, first and last edge, and features; the segments
    and the number of moves of the true segmentations."""

    last: np.ndarray
    of_: np.ndarray
    i: np.ndarray
    j: np.ndarray
    features: np.ndarray
    observed: np.ndarray
    moves: np.ndarray

    @staticmethod
    def of(examples: list[tuple[str, list[tuple[str, int, int]]]]) -> Prepared:
        last, rows, moves = [], [], np.zeros((OUT + 1, OUT + 1))
        for text, truth in examples:
            edges, segments = candidates(text)
            if not segments:
                continue
            at = {e: n for n, e in enumerate(edges)}
            true = {(at.get(a), at.get(b)): KINDS.index(k) for k, a, b in truth}
            rows += [(len(last), i, j, phi, np.eye(OUT)[true[i, j]] if (i, j) in true else np.zeros(OUT)) for i, j, phi in segments]
            starts = {i: (j, true[i, j]) for i, j, _ in segments if (i, j) in true}
            i, before = 0, OUT
            while i < len(edges) - 1:
                i, k = starts.get(i, (i + 1, OUT))
                moves[before, k] += 1
                before = k
            last.append(len(edges) - 1)
        of_, i, j, features, observed = (np.array(x) for x in zip(*rows, strict=True))
        return Prepared(np.array(last), of_, i, j, features, observed, moves)

    def expected(self, segment: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(chance of each segment by kind, expected moves), from forward and backward sums over the edges of all examples."""
        n, edges = len(self.last), int(self.last.max()) + 1
        forward, backward = np.zeros((n, edges, OUT + 1)), np.zeros((n, edges, OUT + 1))
        forward[:, 0, OUT] = 1
        backward[np.arange(n), self.last] = 1
        for j in range(1, edges):
            forward[:, j, OUT] = forward[:, j - 1] @ move[:, OUT]
            own = np.flatnonzero(self.j == j)
            np.add.at(forward[:, j, :OUT], self.of_[own], (forward[self.of_[own], self.i[own]] @ move[:, :OUT]) * segment[own])
        for i in range(edges - 2, -1, -1):
            inside = self.last > i
            backward[inside, i] = backward[inside, i + 1, OUT, None] * move[:, OUT]
            own = np.flatnonzero(self.i == i)
            np.add.at(backward[:, i], self.of_[own], (segment[own] * backward[self.of_[own], self.j[own], :OUT]) @ move[:, :OUT].T)
        whole = forward[np.arange(n), self.last].sum(1)
        changes = np.zeros_like(move)
        outside = forward[:, :-1] * backward[:, 1:, OUT, None] / whole[:, None, None]  # edges behind an example's last have no backward sum
        changes[:, OUT] = outside.sum((0, 1)) * move[:, OUT]
        own = forward[self.of_, self.i][:, :, None] * move[:, :OUT] * (segment * backward[self.of_, self.j, :OUT])[:, None] / whole[self.of_][:, None, None]
        changes[:, :OUT] += own.sum(0)
        return own.sum(1), changes


def examples(n: int = 260, seed: int = 11) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Invented stretches with personal data in many forms, and with figures that are none."""
    r = random.Random(seed)
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice(("an", "the", "re", "on", "sch", "eau", "ción", "il", "ver", "mo")) for _ in range(r.randint(1, 3)))

    def card(k: int = 16) -> str:
        body = r.choice("3456") + num(k - 2)
        return next(body + c for c in "0123456789" if luhn(body + c))

    def grouped(s: str, sizes: tuple[int, ...], sep: str) -> str:
        out, at = [], 0
        for k in sizes:
            out.append(s[at : at + k])
            at += k
        return sep.join(out)

    ip = lambda sep=".": sep.join(str(r.randint(1, 254)) for _ in range(4))
    name = lambda: word() + r.choice(("", ".", "_")) + num(r.randint(1, 2))
    make = {
        "email": (
            lambda: f"{name()}@{word()}.example.{r.choice(('com', 'org'))}",
            lambda: f"{name()} [at] {word()} [dot] com",
            lambda: f"{name()}(at){word()}.net",
            lambda: f"{name()} @ {word()}.org",
        ),
        "ip": (ip, lambda: ip("[.]"), lambda: ip(" . ")),
        "card": (card, lambda: grouped(card(), (4, 4, 4, 4), r.choice(" -.")), lambda: grouped(card(15), (4, 6, 5), r.choice(" -"))),
        "phone": (
            lambda: f"+1 ({num(3)}) 555-{num(4)}",
            lambda: f"({num(3)}) 555-{num(4)}",
            lambda: f"+{num(2)} {num(3)} {num(3)} {num(4)}",
            lambda: f"{r.randint(200, 989)}-{num(3)}-{num(4)}",
            lambda: f"{r.randint(200, 989)}.{num(3)}.{num(4)}",
        ),
    }
    none = (
        lambda: str(r.randint(1900, 2030)),
        lambda: f"{num(4)}-{num(2)}-{num(2)}",
        lambda: f"{r.randint(1, 28)}.{r.randint(1, 12)}.{r.randint(1990, 2030)}",
        lambda: f"{r.randint(1, 999)},{num(3)}.{num(2)}",
        lambda: f"v{num(1)}.{num(1)}.{num(2)}",
        lambda: f"AKIA{num(3)}JDZ{num(2)}P",
        lambda: "".join(r.choice("0123456789abcdef") for _ in range(40)),
        lambda: f"#{num(r.randint(5, 9))}",
        lambda: f"{num(2)}:{num(2)}:{num(2)}",
        lambda: "1" + num(r.randint(12, 17)) + "77",
        lambda: f"{num(4)} {num(4)}",
        lambda: num(r.randint(6, 12)),
        lambda: f"{num(3)} {num(5)} {word()} {num(4)}",
    )
    out = []
    for i in range(n):
        text, truth = " ".join(word() for _ in range(r.randint(0, 3))), []
        for _ in range(r.randint(1, 2)):
            kind = KINDS[i % 4] if r.random() < 0.55 else None
            lead = r.choice(("", "", f"{r.choice(CUES[kind])}: " if kind else "no. "))
            text += (" " if text else "") + lead
            own = r.choice(make[kind])() if kind else r.choice(none)()
            if kind:
                truth.append((kind, len(text), len(text) + len(own)))
            text += own + r.choice(("", ".", ",", "")) + " " + word()
        out.append((text, truth))
    return out


def _edge(text: str, a: int, trigger: int) -> int:
    """Where a stretch begins: at the first white space before its trigger, else at the edge of a piece at or before a."""
    space = next((i for i in range(a, trigger) if text[i].isspace()), None)
    if space is not None:
        return space
    low = max(0, a - AROUND)
    return next((i for i in range(a, low, -1) if not (text[i - 1].isalnum() and text[i].isalnum())), a)


def triggers(text: str) -> Iterator[tuple[int, int]]:
    """Places, by their start, one of which is in every candidate segment: a sign, or runs of digits that have DIGITS
    digits in all within the longest segment."""
    signs = [m.span() for m in SIGN.finditer(text)]
    held: deque[tuple[int, int]] = deque()
    digits = 0
    for m in RUN.finditer(text):
        held.append(m.span())
        digits += m.end() - m.start()
        while m.end() - held[0][1] >= LONGEST:
            a, b = held.popleft()
            digits -= b - a
        if digits >= DIGITS:
            signs.append((held[0][0], m.end()))
    return iter(sorted(signs))


def all_spans(text: str, model: SegmentModel) -> tuple[dict[str, list[tuple[int, int]]], list[tuple[str, int, int]]]:
    """(base spans by kind, all spans): the model's spans that touch no base span are added to them."""
    base = base_spans(text)
    taken = sorted(s for spans in base.values() for s in spans)
    starts = [s for s, _ in taken]
    extra: list[tuple[str, int, int]] = []
    stretches: list[list[int]] = []
    for start, end in triggers(text):
        a, b = max(0, start - AROUND), min(len(text), end + AROUND)
        if stretches and a <= stretches[-1][1]:
            stretches[-1][1] = max(b, stretches[-1][1])
        else:
            stretches.append([a, b, start])
    for a, b, trigger in stretches:
        a = a and _edge(text, a, trigger)
        near = taken[max(0, bisect_left(starts, a) - len(KINDS)) : bisect_left(starts, b)]  # spans of one kind don't overlap
        known = [tuple((s - a, e - a) for s, e in near if e > a)] if near else []
        extra += [(kind, a + x, a + y) for kind, x, y in model.spans(text[a:b], *known)]
    spans = [(k, s, e) for k in KINDS for s, e in sorted([*base[k], *((x, y) for kind, x, y in extra if kind == k)])]
    return base, spans


def _joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def personal_data(docs: DataFrame, model: SegmentModel | None = None) -> DataFrame:
    """(doc_id, base, spans) for every row of docs: arrays of (kind, start, end), in code points, end exclusive.

    base holds the patterns' spans by kind and start, spans these and the model's. The model is fitted on invented
    stretches, the same in every run. Null and empty texts have no spans; very long texts are read whole; repeated rows give repeated results; other columns
    are not read; an empty table gives an empty result."""
    model = model or SegmentModel.fitted(examples())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for block in blocks(batches, "text"):
            every, own = [], []
            for text in block.column("text").to_pylist():
                base, spans = all_spans(text or "", model)
                own.append([{"kind": k, "start": s, "end": e} for k in KINDS for s, e in base[k]])
                every.append([{"kind": k, "start": s, "end": e} for k, s, e in spans])
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(own, kind), pa.array(every, kind)], ["doc_id", "base", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spans = "array<struct<kind: string, start: long, end: long>>"
    return rows.mapInArrow(run, f"doc_id long, base {spans}, spans {spans}")


def query(spark, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    counted = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [counted(k) for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def sha256_of(spans) -> str:
    return hashlib.sha256(_joined(spans).encode()).hexdigest()
