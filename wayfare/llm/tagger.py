"""A bidirectional character LSTM with a linear-chain CRF on top, in numpy.

Batches are time-major: (time, sequence). Both directions run in one array, the second one over the
characters in reverse. Gates are straight between 0 and 1, and cells are read straight between -1 and 1:
numpy works these out many times faster than exponentials, and training uses the same.
"""

from __future__ import annotations

import unicodedata

import numpy as np

#: States of characters: ASCII, then letters, digits, spaces and other signs beyond it, then padding.
PADDING = 132
STATES = PADDING + 1
EMBED, HIDDEN = 8, 8
EPOCHS, BATCH, RATE = 10, 96, 0.015


def _wide_states() -> np.ndarray:
    kinds = {"L": 128, "M": 128, "N": 129, "Z": 130}
    table = np.array([kinds.get(unicodedata.category(chr(i))[0], 131) for i in range(1 << 16)], np.uint8)
    table[:128] = range(128)
    return table


_WIDE = _wide_states()


def states(text: str) -> np.ndarray:
    """The state of every code point of a text."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _WIDE[np.minimum(codes, (1 << 16) - 1)]


class Tagger:
    """Tags for spans of some kinds: 0 outside, 1 + 2 kind at the start of a span, 2 + 2 kind within.

    ``legal`` tells which tag may follow which, ``first`` with which a sequence may begin: within a span
    comes only after its start.
    """

    def __init__(self, kinds: int, seed: int = 5, kind=np.float32):
        tags = 1 + 2 * kinds
        self.legal = np.ones((tags, tags), bool)
        for inner in range(2, tags, 2):
            self.legal[:, inner] = False
            self.legal[[inner - 1, inner], inner] = True
        self.first = np.array([True] + [True, False] * kinds)
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[-2]), shape).astype(kind)
        self.p = {
            "embed": (draw(STATES, EMBED) * np.sqrt(STATES)).astype(kind),
            "input": draw(2, EMBED, 4 * HIDDEN),
            "inner": draw(2, HIDDEN, 4 * HIDDEN),
            "bias": np.zeros((2, 1, 4 * HIDDEN), kind),
            "out": draw(2, HIDDEN, tags),
            "out_0": np.zeros(tags, kind),
            "move": np.zeros((tags, tags), kind),
        }
        self.p["bias"][:, :, HIDDEN : 2 * HIDDEN] = 1  # remember at first

    # -- the network --------------------------------------------------------

    def run(self, ids: np.ndarray, back: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Hidden states (2, time, HIDDEN, sequence) for characters in order and in reverse.

        ``keep`` collects what :meth:`gradients` needs.
        """
        p, (steps, n) = self.p, ids.shape
        # Gates are 0.2 x + 0.5, held between 0 and 1; what is drawn in is held between -1 and 1.
        low = np.zeros((4 * HIDDEN, 1), p["inner"].dtype)
        low[3 * HIDDEN :] = -1
        part = np.full(4 * HIDDEN, 0.2, p["inner"].dtype)
        part[3 * HIDDEN :] = 1
        drive = (p["embed"] @ p["input"] + p["bias"]) * part
        drive[:, :, : 3 * HIDDEN] += 0.5
        drive = np.ascontiguousarray(drive.swapaxes(1, 2))
        inner = np.ascontiguousarray((p["inner"] * part).swapaxes(1, 2))
        hidden = np.empty((2, steps, HIDDEN, n), drive.dtype)
        h, c = np.zeros((2, HIDDEN, n), drive.dtype), np.zeros((2, HIDDEN, n), drive.dtype)
        z = np.empty((2, 4 * HIDDEN, n), drive.dtype)
        read = np.empty((4 * HIDDEN, n), drive.dtype)
        for t in range(steps):
            np.matmul(inner, h, out=z)
            z[0] += np.take(drive[0], ids[t], axis=1, out=read, mode="clip")
            z[1] += np.take(drive[1], back[t], axis=1, out=read, mode="clip")
            np.clip(z, low, 1, out=z)
            before = c
            c = z[:, HIDDEN : 2 * HIDDEN] * c
            c += z[:, :HIDDEN] * z[:, 3 * HIDDEN :]
            h = np.multiply(z[:, 2 * HIDDEN : 3 * HIDDEN], np.clip(c, -1, 1), out=hidden[:, t])
            if keep is not None:
                keep.append((z.copy(), before, c))
        return hidden

    def emissions(self, ids: np.ndarray, sizes: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Tag scores (time, sequence, tags); what lies beyond a sequence's size means nothing."""
        if (sizes == len(ids)).all():
            turned = slice(None, None, -1)
        else:
            turned = np.maximum(sizes[None, :] - 1 - np.arange(len(ids))[:, None], 0), np.arange(ids.shape[1])[None, :]
        hidden = self.run(ids, ids[turned], keep)
        if keep is not None:
            keep.append((hidden, ids))
        scores = np.matmul(self.p["out"][:, None].swapaxes(-1, -2), hidden).transpose(0, 1, 3, 2)
        scores[0] += scores[1][turned]
        scores[0] += self.p["out_0"]
        return scores[0]

    def gradients(self, keep: list, error: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients for ``error``, the loss by emissions, of sequences of full size."""
        p, (hidden, ids) = self.p, keep[-1]
        steps, n = ids.shape
        both = np.stack([error, error[::-1]])
        found = {
            "out": np.einsum("dthn,dtnk->dhk", hidden, both, optimize=True),
            "out_0": error.sum(axis=(0, 1)),
            "inner": np.zeros_like(p["inner"]),
        }
        to_hidden = np.matmul(p["out"][:, None], both.swapaxes(-1, -2))
        dh, dc = np.zeros((2, HIDDEN, n), error.dtype), np.zeros((2, HIDDEN, n), error.dtype)
        every_dz = np.empty((2, steps, 4 * HIDDEN, n), error.dtype)
        low = np.zeros((4 * HIDDEN, 1), error.dtype)
        low[3 * HIDDEN :] = -1
        i, f, o, g = (slice(k * HIDDEN, (k + 1) * HIDDEN) for k in range(4))
        for t in range(steps - 1, -1, -1):
            z, before, c = keep[t]
            dz = every_dz[:, t]
            dh = dh + to_hidden[:, t]
            dc = dc + dh * z[:, o] * (np.abs(c) < 1)
            dz[:, i] = dc * z[:, g]
            dz[:, f] = dc * before
            dz[:, o] = dh * np.clip(c, -1, 1)
            dz[:, g] = dc * z[:, i] * 5
            dz *= 0.2 * ((z > low) & (z < 1))
            if t:
                found["inner"] += hidden[:, t - 1] @ dz.swapaxes(-1, -2)
            dc = dc * z[:, f]
            dh = p["inner"] @ dz
        to_drive = np.empty((2, STATES, 4 * HIDDEN), error.dtype)
        for d, read in enumerate((ids, ids[::-1])):
            shown = (read[:, None, :] == np.arange(STATES)[:, None]).astype(error.dtype)
            to_drive[d] = np.matmul(shown, every_dz[d].swapaxes(-1, -2)).sum(axis=0)
        found["bias"] = to_drive.sum(axis=1, keepdims=True)
        found["input"] = p["embed"].T @ to_drive
        found["embed"] = (to_drive @ p["input"].swapaxes(-1, -2)).sum(axis=0)
        return found

    # -- the chain ----------------------------------------------------------

    def loss(self, scores: np.ndarray, tags: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Mean negative log-likelihood of ``tags`` (time, sequence), and its gradients by scores and moves."""
        steps, n, k = scores.shape
        top = scores.max(axis=2, keepdims=True)
        lift = np.exp(scores - top)
        step = np.exp(self.p["move"]) * self.legal
        ahead, size = np.empty_like(lift), np.empty((steps, n, 1), lift.dtype)
        at = lift[0] * self.first
        for t in range(steps):
            if t:
                at = (ahead[t - 1] @ step) * lift[t]
            size[t] = at.sum(axis=1, keepdims=True)
            ahead[t] = at / size[t]
        log_z = float((np.log(size) + top).sum())
        rear, pairs = np.ones((n, k), lift.dtype), np.zeros((k, k), lift.dtype)
        share = np.empty_like(lift)
        for t in range(steps - 1, -1, -1):
            share[t] = ahead[t] * rear
            if t:
                arriving = lift[t] * rear / size[t]
                pairs += step * (ahead[t - 1].T @ arriving)
                rear = arriving @ step.T
        where = np.arange(steps)[:, None], np.arange(n)[None, :], tags
        seen = np.zeros((k, k), lift.dtype)
        np.add.at(seen, (tags[:-1], tags[1:]), 1)
        told = float(scores[where].sum() + (seen * self.p["move"]).sum())
        share[where] -= 1
        return (log_z - told) / n, share / n, (pairs - seen) / n

    def best(self, scores: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The likeliest legal tags (time, sequence); 0 beyond a sequence's size."""
        steps, n, k = scores.shape
        move = np.where(self.legal, self.p["move"], -np.inf).astype(scores.dtype)
        # Values by tag first, so that all sequences are worked on side by side.
        value = np.empty((steps, k, n), scores.dtype)
        value[0] = scores[0].T + np.where(self.first, 0, -np.inf)[:, None]
        for t in range(1, steps):
            np.max(value[t - 1][:, None] + move[:, :, None], axis=0, out=value[t])
            value[t] += scores[t].T
        tags, every = np.zeros((steps, n), np.int8), np.arange(n)
        tag = value[sizes - 1, :, every].argmax(axis=1)
        for t in range(steps - 1, -1, -1):
            inside = t < sizes
            tags[t][inside] = tag[inside]
            if t:
                came = (value[t - 1] + move[:, tag]).argmax(axis=0)
                tag = np.where(inside, came, tag)
        return tags

    def outside_wins(self, scores: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Whether a sequence is sure to have tag 0 throughout, told without finding its best tags.

        For every kind the best stretch up to each place is grown from its start, charged with the
        cheapest move into it and, where it gains by it, with the cheapest out of it. Where none of them
        scores above tag 0 in its place, no row of stretches does.
        """
        move = np.where(self.legal, self.p["move"], -np.inf) - self.p["move"][0, 0]
        starts, inner = np.arange(1, len(move), 2), np.arange(2, len(move), 2)
        into = move[:, starts].max(axis=0)[:, None]
        after_start, after_inner = move[starts, inner][:, None], move[inner, inner][:, None]
        n = scores.shape[1]
        best = np.full(n, -np.inf, scores.dtype)
        started, held = np.full((len(starts), n), -np.inf, scores.dtype), np.full((len(starts), n), -np.inf, scores.dtype)
        for t in range(len(scores)):
            gain = scores[t].T[1:] - scores[t].T[0]
            held = np.maximum(started + after_start, held + after_inner) + gain[1::2]
            started = gain[::2] + (into if t else np.maximum(into, 0))
            top = np.maximum(started, held).max(axis=0)
            best = np.where(t < sizes, np.maximum(best, top), best)
        return best + max(0.0, float(move[1:, 0].max())) < 0

    def weight(self, scores: np.ndarray, tags: np.ndarray) -> float:
        """How far tags (time) of a stretch score above tag 0 in its place, moves included."""
        move, at = self.p["move"], np.arange(len(tags))
        inner = float(move[tags[:-1], tags[1:]].sum()) + float(move[0, tags[0]] + move[tags[-1], 0])
        return float((scores[at, tags] - scores[:, 0]).sum()) + inner - float(move[0, 0]) * (len(tags) + 1)


def fit(tagger: Tagger, ids: np.ndarray, tags: np.ndarray, epochs: int = EPOCHS, seed: int = 5) -> Tagger:
    """Train on characters and tags (sequence, time), all of one size, by Adam with a falling rate."""
    rng = np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in tagger.p.items()}
    second = {k: np.zeros_like(v) for k, v in tagger.p.items()}
    sizes, step, steps = ids.shape[1], 0, epochs * -(-len(ids) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(ids))
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            keep: list = []
            scores = tagger.emissions(ids[pick].T, np.full(len(pick), sizes), keep)
            _, error, moves = tagger.loss(scores, tags[pick].T)
            found = tagger.gradients(keep, error) | {"move": moves}
            norm = np.sqrt(sum(float((g**2).sum()) for g in found.values()))
            step += 1
            rate = RATE * (1 - 0.95 * step / steps)
            for k, g in found.items():
                g = g * min(1.0, 5.0 / (norm + 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g**2
                tagger.p[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return tagger
