"""Byte-pair encoding and decoding by forced boundaries.

Two byte symbols that stand side by side in no token of the vocabulary can never be joined by a
merge. Such pairs cut a pre-token into fragments that are encoded one by one and put together.
Fragments and whole pre-tokens seen before are looked up.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

#: Distinct pre-tokens that a task keeps, of so many characters at most; beyond that the table starts anew.
TABLE_ROWS, KEPT = 600_000, 64
#: Symbols up to which a fragment is merged by looking through all its pairs.
SHORT = 64
#: Texts of characters below this are normalised and split here, others by the library, whose
#: Unicode tables may be of another version.
PLAIN_END = 0x180

_coders: dict[str, Coder] = {}


def byte_symbols() -> list[str]:
    """The printable stand-in for each byte: itself where it is printable, else from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]


def _class(kind: str) -> str:
    """The plain characters of a Unicode category, as the inside of a character class."""
    return "".join(re.escape(c) for c in map(chr, range(PLAIN_END)) if unicodedata.category(c)[0] == kind)


def plain_words() -> re.Pattern:
    """The pre-token pattern of the vocabulary for plain characters: words, endings after an
    apostrophe, single digits, runs of signs."""
    letters, numbers = _class("L"), _class("N")
    spaces = "\t-\r \x85\xa0"
    return re.compile(f"[{letters}]+|'(?:s|t|re|ve|m|ll|d)|[{numbers}]|[^{spaces}{letters}{numbers}]+")


PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PLAIN = re.compile(f"[\x00-{chr(PLAIN_END - 1)}]*")


class Coder:
    """Encoder and decoder of a word-end BPE vocabulary file."""

    def __init__(self, path: str, rows: int = TABLE_ROWS):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.library = Tokenizer.from_str(json.dumps(spec))
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {pair: rank for rank, pair in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("special tokens of this kind are not handled")
        self.marks = re.compile("(" + "|".join(re.escape(t) for t in self.special) + ")") if self.special else None
        splitter = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        if splitter != PATTERN:
            raise ValueError("this vocabulary splits words in another way")
        self.words = plain_words()
        self.symbols = dict(enumerate(byte_symbols()))
        self.table = str.maketrans({chr(b): s for b, s in self.symbols.items()})
        self.inside = set()
        for token in self.vocab:
            body = token[: -len(self.end)] if self.end and token.endswith(self.end) else token
            self.inside.update(zip(body, body[1:]))
        self.names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.rows = rows
        self.fragments: dict[tuple[str, bool], list[int]] = {}
        self.known: dict[str, tuple[bytes, str]] = {}

    def pre_tokens(self, text: str) -> list[str]:
        """Normalised pre-tokens of a text without special tokens."""
        if text.isascii():
            return self.words.findall(text.lower())
        if PLAIN.fullmatch(text):
            return self.words.findall(unicodedata.normalize("NFC", text).lower())
        shown = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        back = {s: b for b, s in self.symbols.items()}
        return [bytes(back[c] for c in word).decode() for word, _ in shown]

    def cuts(self, word: str) -> Iterator[tuple[str, bool]]:
        """The fragments of a pre-token in byte symbols, and whether each ends it."""
        start = 0
        for i in range(1, len(word)):
            if (word[i - 1], word[i]) not in self.inside:
                yield word[start:i], False
                start = i
        yield word[start:], True

    def merge(self, fragment: str, last: bool) -> list[int]:
        """Ids of one fragment: join the leftmost pair of the lowest rank until no pair has one."""
        rank, none = self.ranks.get, len(self.ranks)
        parts = [*fragment[:-1], fragment[-1] + self.end if last else fragment[-1]]
        if len(parts) > SHORT:
            return self._merge_long(parts)
        ranks = [rank(pair, none) for pair in zip(parts, parts[1:])]
        while ranks and (best := min(ranks)) < none:
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank((parts[i - 1], parts[i]), none)
            if i < len(ranks):
                ranks[i] = rank((parts[i], parts[i + 1]), none)
        return [self.vocab[p] for p in parts if p in self.vocab]

    def _merge_long(self, parts: list[str]) -> list[int]:
        """The same for many symbols: pairs wait in a heap by rank and place, symbols are a linked list."""
        rank, n = self.ranks.get, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        waiting = [(r, i, i + 1) for i in range(n - 1) if (r := rank((parts[i], parts[i + 1]))) is not None]
        heapify(waiting)
        while waiting:
            r, i, j = heappop(waiting)
            # Either end may have been joined since the pair was put in.
            if not parts[i] or after[i] != j or rank((parts[i], parts[j])) != r:
                continue
            parts[i], parts[j] = parts[i] + parts[j], ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank((parts[i], parts[k]))) is not None:
                    heappush(waiting, (r, i, k))
            if (h := before[i]) >= 0 and (r := rank((parts[h], parts[i]))) is not None:
                heappush(waiting, (r, h, i))
        return [self.vocab[p] for p in parts if p in self.vocab]

    def _learn(self, word: str) -> tuple[bytes, str]:
        ids: list[int] = []
        for cut in self.cuts(word.encode().decode("latin-1").translate(self.table)):
            found = self.fragments.get(cut)
            if found is None:
                found = self.merge(*cut)
                if not cut[1] and len(cut[0]) <= KEPT:  # whole pre-tokens are kept below
                    self.fragments[cut] = found
            ids += found
        known = (np.array(ids, "<u4").tobytes(), " ".join(self.names[i] for i in ids))
        if len(word) <= KEPT:
            self.known[word] = known
        return known

    def encode(self, text: str) -> list[tuple[bytes, str]]:
        """Ids (little-endian, 32 bits each) and spelled tokens of the parts of a text, in order."""
        if len(self.known) > self.rows:
            self.known = {}
        if len(self.fragments) > self.rows:
            self.fragments = {}
        found = []
        for part in self.marks.split(text) if self.marks else [text]:
            if part in self.special:
                found.append((np.array([self.special[part]], "<u4").tobytes(), part))
            elif part:
                known = self.known
                found += [known.get(w) or self._learn(w) for w in self.pre_tokens(part)]
        return found

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: their tokens with spaces between, special ones included."""
        return " ".join(map(self.names.__getitem__, ids.tolist()))


def _coder(path: str) -> Coder:
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Ids of every whole text: doc_id, ids (array of int).

    ``vocabulary`` is the path of a word-end BPE file of the tokenizers library. A null text counts
    as empty and has no ids; repeated rows give repeated rows, a null doc_id stays null, other
    columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(vocabulary)
        for batch in batches:
            for one in range(batch.num_rows):
                ids = b"".join(x[0] for x in coder.encode(batch.column("text")[one].as_py() or ""))
                values = pa.array(np.frombuffer(ids, "<u4").astype(np.int32), pa.int32())
                ends = pa.array([0, len(values)], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(one, 1), pa.ListArray.from_arrays(ends, values)], ["doc_id", "ids"]
                )

    read = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return read.mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """Texts of ids: doc_id, text. Null ids count as none and give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(vocabulary)
        for batch in batches:
            texts = [coder.decode(np.array(x.as_py() or [], np.int64)) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Encode and decode every text, keeping digests: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Rows and nulls are handled as in :func:`encode`; an empty text has the digests of no bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(vocabulary)
        for batch in batches:
            counts, ids_out, text_out = [], [], []
            for text in batch.column("text"):
                parts = coder.encode(text.as_py() or "")
                ids = b"".join([x[0] for x in parts])
                counts.append(len(ids) // 4)
                ids_out.append(hashlib.sha256(ids).hexdigest())
                # Each part's spelling is what decode() gives for its ids.
                text_out.append(hashlib.sha256(" ".join([x[1] for x in parts]).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_out), pa.array(text_out)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    read = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return read.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
