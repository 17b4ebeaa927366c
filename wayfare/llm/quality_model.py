"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages. Every passage is encoded from its characters and words; a gated
attention network weighs the passages of a bag, and the weighted sum of their codes is scored. Only
documents carry labels; the weights of passages are learned from them. The network is small and
trained on a bounded sample; every document is scored where it lies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a passage.
PASSAGE = 100
#: Labelled documents that train the network at most, an even choice by hash for each label. Each gives
#: all its passages.
SAMPLE = 6000
#: Width of passage codes and of the attention.
CODE, ATTENTION = 16, 8
EPOCHS, BATCH, RATE, DECAY = 60, 64, 0.01, 1e-4

# Short words that are common in running text.
FUNCTION_WORDS = frozenset(
    b"the of and to in a is that for on with as at by it be are was from this or an der die und den von zu das mit"
    b" ein auf de la le et les des un que qui en el y los se del las con por est pas pour dans".split()
)

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".,;:'\"()-"]] = True
_SHOUT = np.zeros(256, bool)
_SHOUT[[ord(c) for c in "!?"]] = True
_HIGH = np.zeros(256, bool)
_HIGH[128:] = True
_CLASSES = [_UPPER, _LOWER, _DIGIT, _STOP, _SHOUT, _HIGH]
FEATURES = len(_CLASSES) + 8


def _passage(words: list[bytes]) -> list[float]:
    joined = b"".join(words)
    codes = np.frombuffer(joined, np.uint8)
    size, n = max(1, len(joined)), max(1, len(words))
    counts = np.bincount(codes, minlength=256)
    shares = [float(counts[c].sum()) / size for c in _CLASSES]
    different = len(set(words))
    pairs = len(set(zip(words, words[1:]))) / max(1, n - 1) if n > 1 else 1.0
    bare = [w.lower().strip(b".,;:!?") for w in words]
    return [
        *shares,
        1 - sum(shares),
        different / n,
        pairs,
        sum([w in FUNCTION_WORDS for w in bare]) / n,
        sum([len(w) == 1 for w in words]) / n,
        min(size / n, 40) / 10,
        sum([a == b for a, b in zip(words, words[1:])]) / n,
        np.log1p(n) / 5,
    ]


def passages(text: str | None) -> np.ndarray:
    """One row of features per passage of a text; an empty text has one passage without words."""
    words = (text or "").encode().split()
    starts = range(0, max(1, len(words)), PASSAGE)
    return np.array([_passage(words[s : s + PASSAGE]) for s in starts], np.float64)


class Network:
    """Gated attention over passage codes, with its gradients."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
        self.mean, self.scale = mean, scale
        self.p = {
            "encode": draw(FEATURES, CODE),
            "encode_0": np.zeros(CODE),
            "tanh": draw(CODE, ATTENTION),
            "gate": draw(CODE, ATTENTION),
            "weigh": draw(ATTENTION, 1)[:, 0],
            "out": draw(CODE, 1)[:, 0],
            "out_0": np.zeros(1),
        }

    def forward(self, bags: np.ndarray, owner: np.ndarray, n: int) -> dict[str, np.ndarray]:
        """All steps for the passages ``bags`` of ``n`` documents; ``owner`` is each one's document."""
        p = self.p
        x = np.clip((bags - self.mean) / self.scale, -8, 8)
        code = np.tanh(x @ p["encode"] + p["encode_0"])
        tanh, gate = np.tanh(code @ p["tanh"]), 1 / (1 + np.exp(-(code @ p["gate"])))
        # The pull of a passage is bounded by the weights, so exp() needs no shift.
        pull = np.exp((tanh * gate) @ p["weigh"])
        total = np.bincount(owner, pull, n)
        share = pull / total[owner]
        bag = np.zeros((n, CODE))
        np.add.at(bag, owner, share[:, None] * code)
        score = 1 / (1 + np.exp(-(bag @ p["out"] + p["out_0"])))
        return {"x": x, "code": code, "tanh": tanh, "gate": gate, "share": share, "bag": bag, "score": score}

    def gradients(self, f: dict[str, np.ndarray], owner: np.ndarray, error: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the loss for ``error``, the derivative by each document's logit."""
        p = self.p
        to_bag = error[:, None] * p["out"]
        per_passage = to_bag[owner]
        gain = (per_passage * f["code"]).sum(axis=1)
        mean_gain = np.bincount(owner, f["share"] * gain, len(error))
        to_pull = f["share"] * (gain - mean_gain[owner])
        product = to_pull[:, None] * p["weigh"]
        to_tanh = product * f["gate"] * (1 - f["tanh"] ** 2)
        to_gate = product * f["tanh"] * f["gate"] * (1 - f["gate"])
        to_code = f["share"][:, None] * per_passage + to_tanh @ p["tanh"].T + to_gate @ p["gate"].T
        to_input = to_code * (1 - f["code"] ** 2)
        return {
            "encode": f["x"].T @ to_input,
            "encode_0": to_input.sum(axis=0),
            "tanh": f["code"].T @ to_tanh,
            "gate": f["code"].T @ to_gate,
            "weigh": (f["tanh"] * f["gate"]).T @ to_pull,
            "out": f["bag"].T @ error,
            "out_0": np.array([error.sum()]),
        }

    def scores(self, bags: list[np.ndarray]) -> np.ndarray:
        owner = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
        return self.forward(np.concatenate(bags), owner, len(bags))["score"]


def fit(bags: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> Network:
    """Train on bags of passages with 0/1 labels; both labels weigh the same in all."""
    stacked = np.concatenate(bags)
    network = Network(stacked.mean(axis=0), np.maximum(stacked.std(axis=0), 1e-3), seed)
    rng = np.random.default_rng(seed)
    share = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
    weight = np.where(labels > 0, 0.5 / share, 0.5 / (1 - share))
    first = {k: np.zeros_like(v) for k, v in network.p.items()}
    second = {k: np.zeros_like(v) for k, v in network.p.items()}
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            chosen = [bags[i] for i in pick]
            owner = np.repeat(np.arange(len(pick)), [len(b) for b in chosen])
            f = network.forward(np.concatenate(chosen), owner, len(pick))
            error = weight[pick] * (f["score"] - labels[pick]) / len(pick)
            step += 1
            for k, g in network.gradients(f, owner, error).items():
                g = g + DECAY * network.p[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g**2
                network.p[k] -= RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return network


def held_out(doc_id: str = "doc_id"):
    """Whether a row is kept from training, by its id alone; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", sample: int = SAMPLE) -> Network | None:
    """Learn from the labelled documents that are not held out, at most ``sample`` of them.

    The sample is the first by a hash of the id, half of it for each label, where there are enough.
    Rows with a null id or label are left out. None if a label has no document.
    """
    known = labels.where(F.col(target).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.min(target).cast("int").alias("target"))
    order = F.xxhash64("doc_id", F.lit(11))
    halves = [known.where(F.col("target") == y).orderBy(order).limit(sample // 2) for y in (0, 1)]
    chosen = halves[0].unionByName(halves[1])
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(chosen, "doc_id")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = [passages(t.as_py()).astype(np.float32).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("target"), pa.array(bags)], ["doc_id", "target", "bag"])

    # Repeated rows of an id would outgrow the bound; one is enough.
    encoded = texts.mapInArrow(encode, "doc_id long, target int, bag binary")
    rows = encoded.groupBy("doc_id").agg(F.min("target").alias("target"), F.min("bag").alias("bag")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    found = np.array([r["target"] for r in rows], np.float64)
    if len(set(found)) < 2:
        return None
    return fit([np.frombuffer(r["bag"], np.float32).reshape(-1, FEATURES).astype(np.float64) for r in rows], found)


def _scored(network: Network | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores: list[float] = []
            for at in range(0, batch.num_rows, 200):
                bags = [passages(t.as_py()) for t in batch.column("text").slice(at, 200)]
                scores += network.scores(bags).tolist() if network else [0.5] * len(bags)
            kept = [i for i, name in enumerate(batch.schema.names) if name != "text"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in kept], pa.array(scores, pa.float64())],
                [*[batch.schema.names[i] for i in kept], "score"],
            )

    return run


def score(docs: DataFrame, network: Network | None) -> DataFrame:
    """Quality of every whole text: doc_id, held_out, score, predicted.

    ``score`` is between 0 and 1; the higher, the likelier label 1. A null text is scored as an
    empty one. One row per input row, repeated rows and null ids included. Without a network, for
    want of labels, every score is 0.5. Columns besides doc_id and text are ignored.
    """
    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    scored = narrow.mapInArrow(_scored(network), "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, network: Network | None, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more, with all their columns."""
    fields = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good: list[bool] = []
            for at in range(0, batch.num_rows, 200):
                bags = [passages(t.as_py()) for t in batch.column("text").slice(at, 200)]
                good += (network.scores(bags) >= least).tolist() if network else [True] * len(bags)
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, fields)
