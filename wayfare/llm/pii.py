"""Personal data by patterns and by a character LSTM with CRF transitions.

Patterns find the usual spellings. The network is trained on windows of sampled documents, labelled
by the patterns, and on the same windows with made-up personal data in other spellings set into them.
It reads every text in overlapping windows. What the windows find is put together over the whole text:
pieces cut by a window's end are joined, each find is checked exactly for what its kind must be, and
the finds that do not overlap and weigh most together are kept beside the patterns' spans.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm import tagger
from wayfare.llm.tagger import PADDING, Tagger

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # kind, start, end

# The patterns of known personal data. Where a match cannot start inside a run, a look
# behind keeps long runs from being tried at every place.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Characters of a training window; windows with personal data and without that train the network at most,
#: chosen by hash from about as many documents; made-up windows, up to which the sample is filled up.
WINDOW, LABELLED, PLAIN, MADE = 96, 1500, 1500, 3500
#: Characters of a window of the scan and of the overlap of two; windows scanned at once.
SCAN, OVERLAP, AT_ONCE = 512, 64, 1000
#: How far a find must weigh above no find.
MARGIN = 1.0


# -- patterns ---------------------------------------------------------------


def luhn(digits: str) -> bool:
    doubled = [int(d) for d in digits[-2::-2]]
    return (sum(map(int, digits[::-2])) + sum(2 * d - 9 * (d > 4) for d in doubled)) % 10 == 0


def _digits(text: str) -> str:
    return "".join([c for c in text if "0" <= c <= "9"])


def base_spans(text: str) -> list[Span]:
    """Spans of the known spellings by kind, then start: leftmost, non-overlapping within a kind, matches
    that fail their check dropped."""
    found: list[Span] = []
    end = 0
    for m in DOMAIN.finditer(text):
        start = m.start()
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            found.append((0, start, m.end()))
            end = m.end()
    for m in IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m.groups()):
            found.append((1, *m.span()))
    for m in CARD.finditer(text):
        digits = _digits(m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append((2, *m.span()))
    for m in PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            found.append((3, *m.span()))
    return found


# -- exact checks of finds --------------------------------------------------

_AT = re.compile(r"\s*(?:[\[({<]\s*at\s*[\])}>]|(?<=\s)at(?=\s)|@)\s*", re.IGNORECASE)
_DOT = re.compile(r"\s*(?:[\[({<]\s*(?:dot|\.)\s*[\])}>]|(?<=\s)dot(?=\s)|\.)\s*", re.IGNORECASE)
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
_GROUPS = re.compile(r"(?<![A-Za-z0-9])[0-9]+(?![A-Za-z0-9])")
_BETWEEN = re.compile(r"[\x20._/-]{1,2}")
_PHONE_TEXT = re.compile(r"(?:\+|00)?[0-9(][0-9\x20()./-]*[0-9]")


def _cards(text: str) -> list[tuple[int, int]]:
    """The places of numbers that pass the check, made of neighbouring groups of digits."""
    groups = [m.span() for m in _GROUPS.finditer(text)]
    found, i = [], 0
    while i < len(groups):
        sizes, after = 0, i + 1
        best = None
        for j in range(i, len(groups)):
            sizes += groups[j][1] - groups[j][0]
            if sizes > 19 or (j > i and not _BETWEEN.fullmatch(text, groups[j - 1][1], groups[j][0])):
                break
            if sizes >= 13 and luhn(_digits(text[groups[i][0] : groups[j][1]])):
                best, after = (groups[i][0], groups[j][1]), j + 1
        if best:
            found.append(best)
        i = after
    return found


def checked(text: str, span: Span) -> list[Span]:
    """What a find holds that is what its kind must be, its ends put on the ends of words."""
    kind, start, end = span
    while start < end and not (text[start].isalnum() or text[start] in "+([:"):
        start += 1
    while end > start and not (text[end - 1].isalnum() or text[end - 1] == ":"):
        end -= 1
    while start > 0 and end > start and text[start].isalnum() and text[start - 1].isalnum():
        start -= 1
    while 0 < end < len(text) and end > start and text[end].isalnum() and text[end - 1].isalnum():
        end += 1
    found = text[start:end]
    if kind == 0:
        return [(0, start, end)] if _EMAIL.fullmatch(_DOT.sub(".", _AT.sub("@", found, count=1))) else []
    if kind == 1:
        try:
            address = ipaddress.ip_address(_DOT.sub(".", found))
        except ValueError:
            return []
        return [(1, start, end)] if address.version == 4 or found.count(":") >= 3 else []
    if kind == 2:
        return [(2, start + a, start + b) for a, b in _cards(found)]
    if found.count("(") < found.count(")") and text[start - 1 : start] == "(":
        start -= 1
    while start < end and text[start] == "(" and text.count("(", start, end) > text.count(")", start, end):
        start += 1
    found = text[start:end]
    digits = _digits(found)
    written = _PHONE_TEXT.fullmatch(found) and (len(digits) < len(found) or found.startswith("00"))
    return [(3, start, end)] if written and 9 <= len(digits) <= 15 else []


# -- labelled windows -------------------------------------------------------


def tags_of(size: int, spans: list[Span], shift: int = 0) -> np.ndarray:
    """A tag per character: 0 outside, 1 + 2 kind at the start of a span, 2 + 2 kind within."""
    tags = np.zeros(size, np.int8)
    for kind, start, end in spans:
        a, b = max(0, start - shift), min(size, end - shift)
        if a < b:
            tags[a:b] = 2 + 2 * kind
            tags[a] = 1 + 2 * kind
    return tags


def _label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A window around each pattern's span, and one anywhere in each text; each with its tags."""
    for batch in batches:
        rows: dict[str, list] = {"found": [], "part": [], "tags": []}
        for text in batch.column("text").to_pylist():
            if not text:
                continue
            rng, spans = np.random.default_rng(zlib.crc32(text.encode())), base_spans(text)
            last = max(0, len(text) - WINDOW)
            starts = [min(last, max(0, s - int(rng.integers(0, max(1, WINDOW - (e - s)))))) for _, s, e in spans]
            for start in [*starts, int(rng.integers(0, last + 1))]:
                part = text[start : start + WINDOW]
                tags = tags_of(len(part), spans, start)
                rows["found"].append(bool(tags.any()))
                rows["part"].append(part)
                rows["tags"].append(tags.tobytes())
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows["found"], pa.bool_()), pa.array(rows["part"], pa.string()), pa.array(rows["tags"], pa.binary())],
            ["found", "part", "tags"],
        )


def labelled_windows(docs: DataFrame) -> list[tuple[str, bytes]]:
    """(text, tags) of windows of sampled documents: LABELLED with personal data and PLAIN without at most.

    Documents are chosen by hash, about LABELLED + PLAIN of them, and their windows by hash again.
    """
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    total = texts.select(F.count("*").alias("n")).first()["n"]
    share = max(1, total // (LABELLED + PLAIN))
    some = texts.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(share)) == 0).select("text")
    windows = some.mapInArrow(_label, "found boolean, part string, tags binary")
    order = F.xxhash64("part", "tags")
    # Equal windows of copies teach nothing new and would crowd out others.
    windows = windows.groupBy("part", "tags").agg(F.first("found").alias("found"))
    chosen = [windows.where(F.col("found") == found).orderBy(order).limit(n) for found, n in ((True, LABELLED), (False, PLAIN))]
    rows = chosen[0].unionByName(chosen[1]).select("part", "tags").collect()
    return sorted((r["part"], bytes(r["tags"])) for r in rows)


class Inventor:
    """Made-up personal data in many spellings, and things that look a little like it."""

    def __init__(self, seed: int = 13):
        self.rng = np.random.default_rng(seed)

    def one(self, options):
        return options[int(self.rng.integers(len(options)))]

    def digits(self, n: int) -> str:
        return "".join(map(str, self.rng.integers(0, 10, n)))

    def word(self, low: int = 2, high: int = 9, letters: str = "abcdefghijklmnopqrstuvwxyz") -> str:
        return "".join(self.one(letters) for _ in range(int(self.rng.integers(low, high))))

    def email(self) -> str:
        user = self.word() + self.one(["", "", ".", "_", "-"]) + self.one([self.word(), self.digits(2), ""])
        user = user.rstrip("._-") or "a"
        hosts = [self.word(3, 9) for _ in range(self.one([1, 1, 2]))] + [self.one(["com", "org", "net", "de", "fr", "es", "info"])]
        at, dot = self.one([("@", "."), ("@", "."), (" at ", " dot "), ("(at)", "."), (" [at] ", " [dot] "), (" @ ", " . "), ("[at]", "[dot]"), (" AT ", " DOT "), (" (at) ", " (dot) ")])
        return user + at + dot.join(hosts)

    def ip(self) -> str:
        if self.rng.random() < 0.3:
            parts = [f"{int(x):x}" for x in self.rng.integers(0, 1 << 16, 8)]
            cut = int(self.rng.integers(2, 6))
            return ":".join(parts) if self.rng.random() < 0.5 else ":".join(parts[:cut]) + "::" + parts[-1]
        return self.one([".", ".", ".", "[.]", " . ", "(.)", " [.] "]).join(map(str, self.rng.integers(0, 256, 4)))

    def card(self) -> str:
        body = self.digits(int(self.one([15, 15, 15, 14, 12, 18])))
        number = next(body + d for d in "0123456789" if luhn(body + d))
        if self.rng.random() < 0.5:
            return number
        return self.one([" ", "-", ".", "_", "/", "  "]).join(number[i : i + 4] for i in range(0, len(number), 4))

    def phone(self) -> str:
        d = self.digits
        return self.one(
            [
                f"+{d(1)} ({d(3)}) {d(3)}-{d(4)}",
                f"({d(3)}) {d(3)}-{d(4)}",
                f"{d(3)}-{d(3)}-{d(4)}",
                f"{d(3)}.{d(3)}.{d(4)}",
                f"00{d(2)} {d(3)} {d(6)}",
                f"+{d(2)} {d(2)} {d(4)} {d(4)}",
                f"0{d(3)}/{d(7)}",
                f"{d(1)} ({d(3)}) {d(3)}-{d(4)}",
                f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}",
                f"1-{d(3)}-{d(3)}-{d(4)}",
            ]
        )

    def other(self) -> str:
        """What is no personal data: numbers, dates, prices, digests, versions, names, code."""
        d, w = self.digits, self.word
        hexes = "0123456789abcdef"
        return self.one(
            [
                d(int(self.rng.integers(1, 9))),
                f"{d(1)}.{d(1)}.",
                f"{d(2)}.{d(2)}.{d(4)}",
                f"{d(4)}-{d(2)}-{d(2)}",
                f"{d(1)}.{d(1)}.{d(1)}",
                f"{d(3)}.{d(2)}",
                f"{d(2)}:{d(2)}",
                f"{d(2)}:{d(2)}:{d(2)}",
                w(24, 48, hexes),
                w(24, 48, hexes.upper()),
                f'"{w(32, 41, hexes)}"',
                f"{w()}='{w(8, 20, hexes + 'xyzXYZ')}'",
                f"http://{w()}.{w()}.com/{w()}",
                f"{w()}.{w()}({w()})",
                f"@{w()}",
                f"{w()} at {w()}",
                f"{w()}, {w()} at the {w()} dot",
                f"No. {d(6)}",
                f"{d(2)},{d(3)}.{d(2)}",
                f"§ {d(1)}.{d(2)}.{d(1)}.{d(2)}.{d(1)}",
                f"{d(3)}-{d(2)}",
                "A" * int(self.rng.integers(2, 30)),
                f"{w()}{'!' * int(self.rng.integers(1, 4))}",
            ]
        )

    def fill(self, carrier: str) -> tuple[str, list[Span]]:
        """A carrier text with one to three things set between its words."""
        parts, spans, at = [], [], 0
        words = carrier.split(" ")
        places = set(self.rng.integers(0, len(words) + 1, int(self.rng.integers(1, 4))).tolist())
        for i in range(len(words) + 1):
            if i in places:
                for _ in range(self.one([1, 1, 1, 2])):
                    kind = int(self.rng.integers(0, 6))
                    made = getattr(self, (*KINDS, "other", "other")[kind])()
                    before, after = self.one([("", ""), ("", ""), ("", "."), ("", ","), ("(", ")"), ("", "!!"), ("", "###"), ("<", ">"), (": ", "")])
                    if kind < len(KINDS):
                        spans.append((kind, at + len(before), at + len(before) + len(made)))
                    parts.append(before + made + after)
                    at += len(parts[-1]) + 1
            if i < len(words):
                parts.append(words[i])
                at += len(words[i]) + 1
        return " ".join(parts), spans


def training_set(windows: list[tuple[str, bytes]], made: int = MADE, seed: int = 13) -> tuple[np.ndarray, np.ndarray]:
    """Characters and tags (window, WINDOW), of labelled windows and of ``made`` ones built on them."""
    examples = [(part, np.frombuffer(tags, np.int8)) for part, tags in windows]
    carriers = [part for part, tags in examples if not tags.any()] or [""]
    maker = Inventor(seed)
    for i in range(made):
        text, spans = maker.fill(carriers[i % len(carriers)])
        start = int(maker.rng.integers(0, max(1, len(text) - WINDOW + 1)))
        if spans:  # a window that holds the start of a span
            pick = maker.one(spans)[1]
            start = min(max(0, len(text) - WINDOW), max(0, pick - int(maker.rng.integers(0, WINDOW // 2))))
        part = text[start : start + WINDOW]
        examples.append((part, tags_of(len(part), spans, start)))
    ids = np.full((len(examples), WINDOW), PADDING, np.int64)
    tags = np.zeros((len(examples), WINDOW), np.int64)
    for row, (part, marks) in enumerate(examples):
        ids[row, : len(part)] = tagger.states(part)
        tags[row, : len(part)] = marks
    return ids, tags


def train(docs: DataFrame, made: int = MADE) -> Tagger | None:
    """A network trained on :func:`labelled_windows` of ``docs``; None where there is no text."""
    windows = labelled_windows(docs)
    return tagger.fit(Tagger(len(KINDS)), *training_set(windows, made)) if windows else None


# -- the scan ---------------------------------------------------------------


def stretches(tags: np.ndarray) -> list[Span]:
    """The spans that tags spell."""
    found, at = [], 0
    starts = np.flatnonzero(tags & 1)
    for start in starts.tolist():
        inner = tags[start] + 1
        at = start + 1
        while at < len(tags) and tags[at] == inner:
            at += 1
        found.append((int(inner) // 2 - 1, start, at))
    return found


def window_finds(network: Tagger, texts: list[str]) -> Iterator[tuple[int, int, Span, float]]:
    """(text, window end, span, weight) of all windows of all texts; spans by places of the text."""
    windows, codes = [], []
    for i, text in enumerate(texts):
        codes.append(tagger.states(text))
        for start in range(0, max(1, len(text) - OVERLAP), SCAN - OVERLAP):
            if text:
                windows.append((min(SCAN, len(text) - start), i, start))
    # Those of full size go together, which needs no look at each one's end.
    full, short = [w for w in windows if w[0] == SCAN], sorted(w for w in windows if w[0] < SCAN)
    blocks = [part[low : low + AT_ONCE] for part in (full, short) for low in range(0, len(part), AT_ONCE)]
    for some in blocks:
        sizes = np.array([w[0] for w in some])
        ids = np.full((sizes[-1], len(some)), PADDING, np.int64)
        for column, (size, i, start) in enumerate(some):
            ids[:size, column] = codes[i][start : start + size]
        scores = network.emissions(ids, sizes)
        open_ = np.flatnonzero(~network.outside_wins(scores, sizes))
        tags = network.best(np.ascontiguousarray(scores[:, open_]), sizes[open_])
        for column, which in enumerate(open_.tolist()):
            size, i, start = some[which]
            for kind, a, b in stretches(tags[:size, column]):
                weight = network.weight(scores[a:b, which], tags[a:b, column])
                yield i, start + size, (kind, start + a, start + b), weight


def reconcile(text: str, finds: list[tuple[int, Span, float]], known: list[Span]) -> list[Span]:
    """One set of spans for a whole text from what its windows found.

    ``finds``: (window end, span, weight). Pieces of one kind that meet where a window ends are joined.
    Then every find is checked, those that overlap ``known`` go, and of the rest those are taken that
    do not overlap and weigh most together.
    """
    options = [(span, weight) for _, span, weight in finds]
    joined: dict[int, tuple[Span, float, bool]] = {}  # the open piece of each kind
    for window_end, (kind, start, end), weight in sorted(finds, key=lambda f: (f[0], f[1])):
        before = joined.get(kind)
        if before and before[2] and start <= before[0][2] < end:
            whole = (kind, min(start, before[0][1]), end)
            options.append((whole, weight + before[1]))
            joined[kind] = whole, weight + before[1], end == window_end
        else:
            joined[kind] = (kind, start, end), weight, end == window_end
    weights: dict[Span, float] = {}
    for span, weight in options:
        if weight >= MARGIN:
            for good in checked(text, span):
                weights[good] = max(weight, weights.get(good, 0.0))
    free = [s for s in weights if not any(s[1] < e and b < s[2] for _, b, e in known)]
    free.sort(key=lambda s: (s[2], s[1], s[0]))
    ends = [s[2] for s in free]
    best: list[tuple[float, int]] = [(0.0, -1)]  # of the first i finds: their weight, and the last one taken
    for i, span in enumerate(free):
        with_it = best[bisect_right(ends, span[1], 0, i)][0] + weights[span]
        best.append((with_it, i) if with_it > best[i][0] else (best[i][0], -1))
    chosen, i = [], len(free)
    while i:
        if best[i][1] < 0:
            i -= 1
            continue
        span = free[i - 1]
        chosen.append(span)
        i = bisect_right(ends, span[1], 0, i - 1)
    return sorted(chosen)


def scan(network: Tagger | None, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
    """(spans of the patterns, spans that the network adds) of every text."""
    known = [base_spans(t) for t in texts]
    finds: list[list[tuple[int, Span, float]]] = [[] for _ in texts]
    if network:
        for i, window_end, span, weight in window_finds(network, texts):
            finds[i].append((window_end, span, weight))
    return [(k, reconcile(t, f, k) if f else []) for t, f, k in zip(texts, finds, known)]


def spelled(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for kind, start, end in sorted(spans))


def find_personal_data(docs: DataFrame, network: Tagger | None = None) -> DataFrame:
    """Spans of personal data in every whole text.

    Returns doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added: one row per input row,
    repeated rows and null ids included. Counts and digest are of the patterns' spans, ``spans`` has
    also the ``n_added`` ones of the network, all by kind, then start. A null or empty text has none:
    counts 0, spans '' and the digest of ''. ``network`` comes from :func:`train`; without it one is
    trained on ``docs``. Columns besides doc_id and text are ignored.
    """
    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    network = network or train(narrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                found = scan(network, [t or "" for t in part.column("text").to_pylist()])
                columns = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in range(len(KINDS))]
                digests = [hashlib.sha256(spelled(base).encode()).hexdigest() for base, _ in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        *columns,
                        pa.array(digests, pa.string()),
                        pa.array([spelled(base + added) for base, added in found], pa.string()),
                        pa.array([len(added) for _, added in found], pa.int64()),
                    ],
                    ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"],
                )

    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return narrow.mapInArrow(run, f"doc_id long, {counts}, base_sha256 string, spans string, n_added long")
