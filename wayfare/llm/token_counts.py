"""Token counts of a sentencepiece model from pre-token frequencies.

A text is cut where no piece of the vocabulary reaches across, so the pieces of each pre-token
are the same wherever it stands. Every distinct pre-token of a task is counted once and kept in a
bounded table; a document's count is the sum over its own pre-token frequencies. Ids of whole
documents are never built.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

#: The mark that sentencepiece writes for a space.
MARK = "▁"
#: A run of spaces with what follows up to the next.
SPACED = re.compile(rf"{MARK}+[^{MARK}]*")
#: Distinct pre-tokens that a task keeps; beyond that the table starts anew.
TABLE_ROWS = 500_000

_models: dict[str, PieceCounts] = {}


class PieceCounts:
    """Counts of pieces by pre-token."""

    def __init__(self, model: str, rows: int = TABLE_ROWS):
        self.model = SentencePieceProcessor(model_file=model)
        self.rows = rows
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("pieces of this model reach across words")
        self.table: dict[str, int] = {"": 1}

    @staticmethod
    def pre_tokens(text: str) -> list[str]:
        """The pre-tokens of a text, each without the one space that stands before it.

        The model puts a space before the text. Only runs of spaces need more than a split.
        """
        if not text:
            return []
        if text[0] != " " and "  " not in text and MARK not in text:
            return text.split(" ")
        return [t[1:] for t in SPACED.findall(MARK + text.replace(" ", MARK))]

    def _learn(self, tokens: list[str]) -> None:
        # The model puts back the space that pre_tokens() took away.
        for token, ids in zip(tokens, self.model.encode(tokens, num_threads=1), strict=True):
            self.table[token] = len(ids)

    def counts(self, texts: list[str]) -> list[int]:
        """Number of pieces of each text."""
        frequencies = [Counter(self.pre_tokens(t)) for t in texts]
        if len(self.table) > self.rows:
            self.table = {"": 1}
        new = {t for f in frequencies for t in f if t not in self.table}
        if new:
            self._learn(list(new))
        table = self.table
        return [sum([table[t] * n for t, n in f.items()]) for f in frequencies]


def _model(path: str) -> PieceCounts:
    if path not in _models:
        _models[path] = PieceCounts(path)
    return _models[path]


#: Characters of text that are counted together.
STEP = 4_000_000


def _steps(texts: list[str]) -> Iterator[list[str]]:
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= STEP:
            yield held
            held, size = [], 0
    if held:
        yield held


def token_counts(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """Bytes and tokens of every whole text: doc_id, n_bytes, n_tokens, over_limit.

    ``model`` is the path of a sentencepiece BPE model whose pieces stay within words. Counts are
    without begin, end or added special tokens; special strings inside a text are ordinary text.
    A null text counts as empty, with no bytes and no tokens. Repeated rows give repeated rows, a
    null doc_id stays null, other columns are ignored. ``over_limit``: more than ``limit`` tokens.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _model(model)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            numbers = [n for step in _steps(texts) for n in pieces.counts(step)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(t.encode()) for t in texts], pa.int64()),
                    pa.array(numbers, pa.int64()),
                ],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    read = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    counted = read.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
