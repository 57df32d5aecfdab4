"""A gated recurrent language model in numpy, with a class-factored output softmax.

P(word | state) = P(class | state) P(word | class, state). The most frequent words are in
classes of consecutive frequency, with a softmax over the class's words. All other words
are in classes by their last bytes, inside which a word has its add-one frequency, and one
more share is left for words never seen: so every word has a probability, and all of them add up to one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np


@dataclass(frozen=True)
class Shape:
    """Sizes of the model: they bound its memory and what a task sends."""

    words: int = 2048
    class_words: int = 64
    other_classes: int = 32
    hidden: int = 16
    window: int = 24
    lanes: int = 384
    rate: float = 0.06


class Model:
    """Parameters of one vector, as named views."""

    def __init__(self, shape: Shape, words: int, vector: np.ndarray | None = None) -> None:
        self.shape, self.words = shape, words
        self.word_classes = -(-words // shape.class_words)
        self.classes = self.word_classes + shape.other_classes
        self.padded = self.word_classes * shape.class_words
        h = shape.hidden
        sizes = {
            "inputs": (words + shape.other_classes, 3 * h),
            "recurrent": (h, 3 * h),
            "gates": (3 * h,),
            "class_out": (h, self.classes),
            "class_bias": (self.classes,),
            "word_out": (self.padded, h),
            "word_bias": (self.padded,),
        }
        total = sum(int(np.prod(s)) for s in sizes.values())
        self.vector = np.zeros(total, np.float32) if vector is None else vector.astype(np.float32, copy=True)
        self.views(self.vector, sizes, self)
        self.sizes = sizes

    @staticmethod
    def views(vector: np.ndarray, sizes: dict[str, tuple[int, ...]], to: object) -> None:
        at = 0
        for name, shape in sizes.items():
            n = int(np.prod(shape))
            setattr(to, name, vector[at : at + n].reshape(shape))
            at += n

    @classmethod
    def fresh(cls, shape: Shape, counts: np.ndarray, other_counts: np.ndarray, seed: int = 7) -> Model:
        """Small random weights; biases that give the words' and classes' frequencies."""
        model = cls(shape, len(counts))
        rng = np.random.default_rng(seed)
        model.inputs[:] = rng.normal(0, 0.3, model.inputs.shape)
        model.recurrent[:] = rng.normal(0, 0.3, model.recurrent.shape)
        model.class_out[:] = rng.normal(0, 0.05, model.class_out.shape)
        model.word_out[:] = rng.normal(0, 0.05, model.word_out.shape)
        padded = np.zeros(model.padded)
        padded[: len(counts)] = counts
        # A place without a word gets no probability.
        model.word_bias[:] = np.where(padded > 0, np.log(np.maximum(padded, 1)), -1e4)
        mass = np.concatenate([padded.reshape(model.word_classes, shape.class_words).sum(1), other_counts])
        model.class_bias[:] = np.log(mass + 1)
        return model

    def class_of(self, tokens: np.ndarray) -> np.ndarray:
        return np.where(tokens < self.words, tokens // self.shape.class_words, self.word_classes + tokens - self.words)


def lanes_of(docs: list[np.ndarray], most: int) -> tuple[list[list[int]], np.ndarray]:
    """Documents dealt to lanes of near-equal length, the longest lane first; and the lanes' lengths."""
    sizes = np.array([len(d) for d in docs])
    wide = int(max(1, min(most, len(docs), -(-sizes.sum() // max(1, sizes.max())) * 2)))
    lanes: list[list[int]] = [[] for _ in range(wide)]
    filled = np.zeros(wide, np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        k = int(np.argmin(filled))
        lanes[k].append(i)
        filled[k] += sizes[i]
    order = np.argsort(-filled, kind="stable")
    return [lanes[k] for k in order.tolist()], filled[order]


def windows_of(docs: list[np.ndarray], shape: Shape, start: int) -> Iterator[tuple[np.ndarray, ...]]:
    """inputs, targets, fresh, owner by time and lane for each window, over lanes that still have tokens.

    fresh: a document begins, the state is empty and the input is the end token. Lanes end
    at different times; a lane's last window is filled up with owner -1.
    """
    lanes, lengths = lanes_of(docs, shape.lanes)
    order = [i for lane in lanes for i in lane]
    sizes = np.array([len(docs[i]) for i in order])
    # All lanes one behind the other; a lane's window is a slice from its begin on.
    targets = np.concatenate([docs[i] for i in order]).astype(np.int64)
    owners = np.repeat(np.array(order), sizes)
    firsts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    inputs = np.concatenate([[start], targets[:-1]])
    inputs[firsts] = start
    begins = np.zeros(len(targets), bool)
    begins[firsts] = True
    lane_begins = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    for low in range(0, int(lengths[0]), shape.window):
        live = int(np.searchsorted(-lengths, -low, "left"))
        span = min(shape.window, int(lengths[0]) - low)
        step = low + np.arange(span)[:, None]
        real = step < lengths[:live]
        at = np.where(real, lane_begins[:live] + step, 0)
        who = np.where(real, owners[at], -1)
        yield np.where(real, inputs[at], start), np.where(real, targets[at], 0), begins[at] & real, who


#: Lanes and tokens of a window in scoring. Nothing is learned between windows, so these change no score; wide lanes need fewer steps.
SCORING_LANES, SCORING_TOKENS = 1536, 12_288


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.divide(1, x, out=x)


#: Logits are cut here before exp: far above what bounded states and trained weights give, and safe in single precision.
_MOST_LOGIT = np.float32(60)


def _exps(x: np.ndarray, cut: bool) -> np.ndarray:
    """In place."""
    if cut:
        np.minimum(x, _MOST_LOGIT, out=x)
    return np.exp(x, out=x)


def _may_exceed(weights: np.ndarray, bias: np.ndarray) -> bool:
    """Whether a logit can be so large that it must be cut: states are between -1 and 1."""
    reach = np.abs(weights) @ np.ones(weights.shape[1], np.float32)
    return not float((reach + bias).max(initial=0)) < _MOST_LOGIT - 1


def forward(
    model: Model, x: np.ndarray, fresh: np.ndarray, h: np.ndarray, learn: bool = True
) -> tuple[np.ndarray, dict]:
    """The states after each input of a window, and what the way back needs, by time, feature and lane."""
    n, k, hid = *x.shape, model.shape.hidden
    fed = model.inputs + model.gates
    # Features first, so that each gate of all lanes is one block. Without the way back, one step's gates are enough.
    deep = n if learn else 1
    states = np.empty((n, hid, k), np.float32)
    gates, before, news = (np.empty((deep, m, k), np.float32) for m in (3 * hid, hid, hid))
    taken, product, both = np.empty((3, k, 3 * hid), np.float32)
    some_fresh = fresh.any(1)
    h = h.T
    for t in range(n):
        at = t if learn else 0
        old, new, turned = before[at], news[at], gates[at]
        old[:] = h
        if some_fresh[t]:
            old[:, fresh[t]] = 0
        np.take(fed, x[t], axis=0, out=taken, mode="clip")
        np.matmul(old.T, model.recurrent, out=product)
        np.add(product, taken, out=both)
        turned[: 2 * hid] = both[:, : 2 * hid].T
        turned[2 * hid :] = product[:, 2 * hid :].T
        _sigmoid(turned[: 2 * hid])
        np.multiply(turned[hid : 2 * hid], turned[2 * hid :], out=new)
        new += taken[:, 2 * hid :].T
        np.tanh(new, out=new)
        h = np.subtract(old, new, out=states[t])
        h *= turned[:hid]
        h += new
    kept = {"before": before, "gates": gates, "new": news} if learn else {}
    return np.ascontiguousarray(states.transpose(0, 2, 1)), kept


#: Rows whose logits are worked on at once, so that they stay in a core's cache. The last piece is the larger one:
#: a product of few rows may be rounded in another order than one of many.
_ROWS = 2304


def output(model: Model, states: np.ndarray, y: np.ndarray, grad: Model | None) -> tuple[np.ndarray, np.ndarray | None]:
    """log10 of each target's class and word given the state; with `grad`, gradients too."""
    # In order of the classes, so that each class's states are one slice.
    cls = model.class_of(y)
    order = np.argsort(cls.astype(np.min_scalar_type(model.classes)), kind="stable")
    states, y, cls = states[order], y[order], cls[order]
    every = np.arange(len(y))
    logs = np.empty(len(y))
    edges = [*range(0, len(y) - _ROWS + 1, _ROWS)] or [0]
    p = np.empty((len(y) if grad is not None else min(2 * _ROWS, len(y)), model.classes), np.float32)
    back = None if grad is None else np.empty_like(states)
    ones = np.ones(model.classes, np.float32)
    cut = _may_exceed(model.class_out.T, model.class_bias)
    for low, high in zip(edges, [*edges[1:], len(y)]):
        rows = slice(low, high)
        own, at = cls[rows], every[: high - low]
        part = np.matmul(states[rows], model.class_out, out=p[rows] if grad is not None else p[: len(own)])
        part += model.class_bias
        inside = np.minimum(part[at, own], _MOST_LOGIT)
        # The sum as a product, which is the fastest reduction.
        sums = _exps(part, cut) @ ones
        logs[rows] = inside
        logs[rows] -= np.log(sums)
        if grad is not None:
            part *= (1 / sums)[:, None]
            part[at, own] -= 1
            np.matmul(part, model.class_out.T, out=back[rows])
    if grad is not None:
        grad.class_out += states.T @ p
        grad.class_bias += np.ones(len(y), np.float32) @ p
    size = model.shape.class_words
    cut = _may_exceed(model.word_out, model.word_bias)
    edges = np.searchsorted(cls, np.arange(model.word_classes + 1)).tolist()
    inner = [(slice(low, high), slice(c * size, (c + 1) * size)) for c, (low, high) in enumerate(zip(edges, edges[1:])) if high > low]
    q = np.empty((edges[-1], size), np.float32)
    for rows, block in inner:
        part = np.matmul(states[rows], model.word_out[block].T, out=q[rows])
        part += model.word_bias[block]
    at, own = every[: len(q)], y[: len(q)] % size
    inside = np.minimum(q[at, own], _MOST_LOGIT)
    _exps(q, cut)
    # The sums class by class, as rows of one product may be rounded by their place.
    sums, ones = np.empty(len(q), np.float32), np.ones(size, np.float32)
    for rows, _ in inner:
        sums[rows] = q[rows] @ ones
    logs[: len(q)] += inside - np.log(sums)
    if grad is not None:
        q *= (1 / sums)[:, None]
        q[at, own] -= 1
        for rows, block in inner:
            part = q[rows]
            grad.word_out[block] += part.T @ states[rows]
            grad.word_bias[block] += np.ones(len(part), np.float32) @ part
            back[rows] += part @ model.word_out[block]
    out = np.empty_like(logs)
    out[order] = logs / np.log(10)
    if back is None:
        return out, None
    unsorted = np.empty_like(back)
    unsorted[order] = back
    return out, unsorted


def backward(model: Model, x: np.ndarray, fresh: np.ndarray, kept: dict, back: np.ndarray, grad: Model) -> None:
    """Backpropagation through the window's steps."""
    n, k, hid = back.shape
    back = np.ascontiguousarray(back.transpose(0, 2, 1))
    turned, dnews = np.empty((n, 3 * hid, k), np.float32), np.empty((n, hid, k), np.float32)
    gates, new, before = kept["gates"], kept["new"], kept["before"]
    z, r, inner = gates[:, :hid], gates[:, hid : 2 * hid], gates[:, 2 * hid :]
    # What does not depend on later steps, for the whole window at once.
    rest, slope, moved = 1 - gates[:, : 2 * hid], 1 - new * new, before - new
    dh = np.zeros((hid, k), np.float32)
    some_fresh = fresh.any(1)
    for t in reversed(range(n)):
        dh += back[t]
        step, dnew = turned[t], dnews[t]
        np.multiply(dh, rest[t, :hid], out=dnew)
        dnew *= slope[t]
        np.multiply(dh, moved[t], out=step[:hid])
        np.multiply(dnew, inner[t], out=step[hid : 2 * hid])
        step[: 2 * hid] *= gates[t, : 2 * hid]
        step[: 2 * hid] *= rest[t]
        np.multiply(dnew, r[t], out=step[2 * hid :])
        grad.recurrent += before[t] @ step.T
        dh *= z[t]
        dh += (step.T @ model.recurrent.T).T
        if some_fresh[t]:
            dh[:, fresh[t]] = 0
    rows = np.empty((n, k, 3 * hid), np.float32)
    rows[:, :, : 2 * hid] = turned[:, : 2 * hid].transpose(0, 2, 1)
    rows[:, :, 2 * hid :] = dnews.transpose(0, 2, 1)
    flat, rows = x.ravel(), rows.reshape(-1, 3 * hid)
    grad.gates += rows.sum(0)
    order = np.argsort(flat.astype(np.min_scalar_type(len(model.inputs))), kind="stable")
    first = np.flatnonzero(np.concatenate([[True], np.diff(flat[order]) > 0]))
    grad.inputs[flat[order[first]]] += np.add.reduceat(rows[order], first, axis=0)


class Trainer:
    """Adagrad over the windows of documents, in the order they come."""

    def __init__(self, model: Model) -> None:
        self.model, self.grad = model, Model(model.shape, model.words)
        self.seen = np.full_like(model.vector, 1e-2)
        self.spare = np.empty_like(model.vector)
        self.tokens = 0

    def train(self, docs: list[np.ndarray], start: int) -> None:
        model, grad, h = self.model, self.grad, None
        for x, y, fresh, who in windows_of(docs, model.shape, start):
            h = np.zeros((x.shape[1], model.shape.hidden), np.float32) if h is None else h[: x.shape[1]]
            states, kept = forward(model, x, fresh, h)
            h = states[-1]
            real = who.ravel() >= 0
            grad.vector[:] = 0
            flat = states.reshape(-1, model.shape.hidden)
            if real.all():
                _, full = output(model, flat, y.ravel(), grad)
            else:
                _, back = output(model, flat[real], y.ravel()[real], grad)
                full = np.zeros_like(flat)
                full[real] = back
            backward(model, x, fresh, kept, full.reshape(states.shape), grad)
            g, spare = grad.vector, self.spare
            # By a full window's size: the last few long texts of a batch move the model no more than their share.
            g /= np.float32(np.sqrt(model.shape.window * model.shape.lanes))
            self.seen += np.multiply(g, g, out=spare)
            g *= np.float32(model.shape.rate)
            g /= np.sqrt(self.seen, out=spare)
            model.vector -= g
            self.tokens += int(real.sum())


def log10_likelihood(model: Model, docs: list[np.ndarray], start: int) -> np.ndarray:
    """Of each document: its tokens' classes and words, with the state carried from window to window."""
    scores = np.zeros(len(docs))
    h = None
    sizes = [len(d) for d in docs]
    wide = min(SCORING_LANES, -(-sum(sizes) // max([1, *sizes])) * 2)
    shape = replace(model.shape, lanes=SCORING_LANES, window=max(1, SCORING_TOKENS // max(1, wide)))
    for x, y, fresh, who in windows_of(docs, shape, start):
        h = np.zeros((x.shape[1], model.shape.hidden), np.float32) if h is None else h[: x.shape[1]]
        states, _ = forward(model, x, fresh, h, learn=False)
        h = states[-1]
        real = who.ravel() >= 0
        logs, _ = output(model, states.reshape(-1, model.shape.hidden)[real], y.ravel()[real], None)
        scores += np.bincount(who.ravel()[real], logs, minlength=len(docs))
    return scores
