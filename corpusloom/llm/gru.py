"""A gated recurrent language model in numpy: truncated backpropagation through time, and an output
softmax factored into the classes of the symbols and the symbols within a class."""

from __future__ import annotations

import functools
import heapq
import math
from collections.abc import Iterator

import numpy as np


def class_bounds(weights: np.ndarray) -> np.ndarray:
    """Where classes of consecutive symbols begin, and the end: those with the fewest logits a symbol, which are
    the number of classes and the symbol's class's size, on average by the symbols' weights."""
    n = len(weights)
    share = np.concatenate(([0.0], np.cumsum(weights / weights.sum())))
    least, before, widest = np.zeros(n + 1), np.zeros(n + 1, np.int64), int(64 * np.sqrt(n))
    for end in range(1, n + 1):
        starts = np.arange(max(0, end - widest), end)
        costs = least[starts] + 1 + (share[end] - share[starts]) * (end - starts)
        best = int(costs.argmin())
        least[end], before[end] = costs[best], starts[best]
    bounds = [n]
    while bounds[-1]:
        bounds.append(int(before[bounds[-1]]))
    return np.array(bounds[::-1])


def _gate(x: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(x)), in place; exp takes about half the time of tanh."""
    with np.errstate(over="ignore"):
        np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


@functools.cache
def _ones(n: int) -> np.ndarray:
    return np.ones(n, np.float32)


def _log_pick(x: np.ndarray, at: np.ndarray, small: bool) -> np.ndarray:
    """Entry `at` of each row's log softmax; overwrites `x`. `small`: exp stays within single precision."""
    if not small:
        x -= x.max(axis=1, keepdims=True)
    picked = np.take(x.reshape(-1), np.arange(len(x)) * x.shape[1] + at)
    np.exp(x, out=x)
    return picked - np.log(x @ _ones(x.shape[1]))


def _order(symbols: np.ndarray) -> np.ndarray:
    """The places of `symbols` in ascending order, and so by class; numbers of 16 bits are sorted by radix."""
    return np.argsort(symbols.astype(np.uint16) if not len(symbols) or symbols.max() < 1 << 16 else symbols, kind="stable")


def _sum_by(keys: np.ndarray, rows: np.ndarray, out: np.ndarray) -> None:
    """Into `out`, zeros, the sum of the rows of each key; `keys` ascend."""
    first = np.flatnonzero(np.concatenate(([True], np.diff(keys) != 0)))
    out[keys[first]] = np.add.reduceat(rows, first, axis=0)


def _with_ones(states: np.ndarray) -> np.ndarray:
    """A column of ones after the states: a product with it adds the bias, and its gradient is that of the bias."""
    out = np.empty((len(states), states.shape[1] + 1), np.float32)
    out[:, :-1], out[:, -1] = states, 1
    return out


class Room:
    """Arrays that each window writes anew, in memory that is kept: fresh pages cost as much as the work on them."""

    def __init__(self):
        self.kept: dict[str, np.ndarray] = {}

    def __call__(self, name: str, *shape: int) -> np.ndarray:
        size = math.prod(shape)
        if name not in self.kept or len(self.kept[name]) < size:
            self.kept[name] = np.empty(size, np.float32)
        return self.kept[name][:size].reshape(shape)

    def __reduce__(self):
        return Room, ()


class Gru:
    """Class k has the symbols from bounds[k] up to bounds[k + 1]; `end` resets the state.

    Parameters: x, the inputs of reset gate, update gate and candidate for each symbol; u, the
    recurrent weights of the three (gates open as these fall); c and cb, class weights and biases;
    o and ob, those of the symbols within their classes.
    """

    NAMES = ("x", "u", "c", "cb", "o", "ob")

    def __init__(self, weights: np.ndarray, hidden: int = 16, seed: int = 3):
        """Starts as the unigram model of the symbols' `weights` (positive)."""
        self.symbols, self.hidden, self.end, self.room = len(weights), hidden, len(weights) - 1, Room()
        self.bounds = class_bounds(weights)
        sizes = np.diff(self.bounds)
        self.class_of = np.repeat(np.arange(len(sizes)), sizes)
        rng = np.random.default_rng(seed)

        def small(*shape: int, by: float) -> np.ndarray:
            return rng.normal(0, by, shape).astype(np.float32)

        self.x = small(3, self.symbols, hidden, by=0.1)
        self.x[1] -= 1.0
        self.u = small(3, hidden, hidden, by=1 / np.sqrt(hidden))
        self.c = np.zeros((hidden, len(sizes)), np.float32)
        self.o = np.zeros((hidden, self.symbols), np.float32)
        by_class = np.add.reduceat(weights, self.bounds[:-1])
        self.cb = np.log(by_class).astype(np.float32)
        self.ob = np.log(weights / by_class[self.class_of]).astype(np.float32)

    def vector(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).ravel() for n in self.NAMES])

    def load(self, vector: np.ndarray) -> None:
        at = 0
        for n in self.NAMES:
            old = getattr(self, n)
            setattr(self, n, vector[at : at + old.size].reshape(old.shape).astype(np.float32))
            at += old.size

    def view(self, vector: np.ndarray) -> None:
        """Parameters that share the memory of `vector` (single precision)."""
        at = 0
        for n in self.NAMES:
            old = getattr(self, n)
            setattr(self, n, vector[at : at + old.size].reshape(old.shape))
            at += old.size

    def small(self) -> bool:
        """Whether no logit can come near the limit of exp in single precision; states are within -1 and 1."""
        by_class = np.abs(self.c).sum(axis=0) + np.abs(self.cb)
        inside = np.abs(self.o).sum(axis=0) + self.ob
        return bool(by_class.max() < 60 and inside.max() < 60)

    def output(self) -> tuple[np.ndarray, np.ndarray]:
        """Weights of the classes and of the symbols, each with its biases in a last row."""
        return np.concatenate((self.c, self.cb[None])), np.concatenate((self.o, self.ob[None]))

    def by_class(self, targets: np.ndarray) -> Iterator[tuple[slice, slice]]:
        """For each class that the ascending `targets` have: its rows and its symbols."""
        ends = np.searchsorted(targets, self.bounds)
        for k in np.flatnonzero(np.diff(ends)).tolist():
            yield slice(ends[k], ends[k + 1]), slice(self.bounds[k], self.bounds[k + 1])

    def ended(self, ids: np.ndarray) -> list[np.ndarray]:
        """The streams that have an end, for each time of `ids`."""
        times, streams = np.nonzero(ids == self.end)
        return np.split(streams, np.searchsorted(times, np.arange(1, len(ids))))

    def steps(self, ids: np.ndarray, h: np.ndarray, keep: bool = True) -> tuple[np.ndarray, np.ndarray, list]:
        """The states before each of the symbols `ids` (time by stream), the last state, and, to
        `keep`, what the gradients need: gates, candidates and the candidates' recurrent parts. All
        but the last state are overwritten by the next call."""
        n, (time, streams) = self.hidden, ids.shape
        states, inputs = self.room("states", time, streams, n), self.room("inputs", 3, time, streams, n)
        kept = [self.room(name, time if keep else 1, *shape) for name, shape in (("gates", (3, streams, n)), ("candidate", (streams, n)))]
        for x, own in zip(self.x, inputs, strict=True):
            np.take(x, ids, axis=0, out=own, mode="clip")
        ended = self.ended(ids)
        for t in range(time):
            states[t] = h
            gates, candidate = (part[t if keep else 0] for part in kept)
            np.matmul(states[t], self.u, out=gates)
            both, inner = gates[:2], gates[2]
            both += inputs[:2, t]
            _gate(both)
            r, z = both
            np.multiply(r, inner, out=candidate)
            candidate += inputs[2, t]
            np.tanh(candidate, out=candidate)
            h = np.subtract(states[t], candidate)
            h *= z
            h += candidate
            if len(ended[t]):
                h[ended[t]] = 0
        return states, h, kept

    def log_probs(self, states: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Natural log probabilities of `targets` in `states` (rows)."""
        order = _order(targets)
        flat, targets = _with_ones(np.take(states, order, axis=0)), targets[order]
        small, (classes, symbols) = self.small(), self.output()
        logs = _log_pick(np.matmul(flat, classes, out=self.room("classes", len(flat), len(self.cb))), self.class_of[targets], small)
        for own, members in self.by_class(targets):
            logits = self.room("members", own.stop - own.start, members.stop - members.start)
            logs[own] += _log_pick(np.matmul(flat[own], symbols[:, members], out=logits), targets[own] - members.start, small)
        found = np.empty_like(logs)
        found[order] = logs
        return found

    def gradients(self, ids: np.ndarray, h: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the mean loss over a window of `ids`, and the state to carry on with."""
        states, last, kept = self.steps(ids, h)
        time, streams, n = states.shape
        targets = ids.reshape(-1)
        order = _order(targets)
        targets = targets[order]
        flat, share = _with_ones(np.take(states.reshape(-1, n), order, axis=0)), np.float32(1 / len(targets))
        g = {k: np.zeros_like(getattr(self, k)) for k in self.NAMES}
        small, (classes, symbols) = self.small(), self.output()

        def errors(logits: np.ndarray, places: np.ndarray) -> np.ndarray:
            """In place: the loss's gradient by the logits; `places` are those of the targets."""
            if not small:
                logits -= logits.max(axis=1, keepdims=True)
            np.exp(logits, out=logits)
            logits *= (share / (logits @ _ones(logits.shape[1])))[:, None]
            logits.reshape(-1)[places] -= share
            return logits

        rows, own_class = np.arange(len(targets)), self.class_of[targets]
        error = errors(np.matmul(flat, classes, out=self.room("classes", len(flat), len(self.cb))), rows * len(self.cb) + own_class)
        first, widths = self.bounds[:-1], np.diff(self.bounds)
        places = (rows - np.searchsorted(targets, first)[own_class]) * widths[own_class] + targets - first[own_class]
        g["c"], g["cb"] = np.split(flat.T @ error, [n])
        g["cb"] = g["cb"][0]
        by_state = np.matmul(error, self.c.T, out=self.room("by_state", len(flat), n))
        for own, members in self.by_class(targets):
            some = flat[own]
            logits = self.room("members", len(some), members.stop - members.start)
            error = errors(np.matmul(some, symbols[:, members], out=logits), places[own])
            product = some.T @ error
            g["o"][:, members], g["ob"][members] = product[:-1], product[-1]
            by_state[own] += error @ self.o[:, members].T
        back = self.room("back", len(flat), n)
        back[order] = by_state
        back = back.reshape(states.shape)
        gates, candidate = kept
        r, z, inner = gates[:, 0], gates[:, 1], gates[:, 2]
        ended = self.ended(ids)
        # What the error of the state after each symbol is multiplied with to be that of the gates and the candidate.
        keeping = np.subtract(1, z, out=self.room("keeping", *states.shape))
        by_c = np.multiply(candidate, candidate, out=self.room("by_c", *states.shape))
        np.subtract(1, by_c, out=by_c)
        by_c *= keeping
        through = self.room("through", 3, time, streams, n)
        by_r, by_z, by_h = through
        np.multiply(by_c, r, out=by_h)
        np.subtract(r, 1, out=by_r)
        by_r *= by_h
        by_r *= inner
        np.subtract(candidate, states, out=by_z)
        by_z *= z
        by_z *= keeping
        dh, part = np.zeros((streams, n), np.float32), self.room("part", 3, streams, n)
        turned = self.u.transpose(0, 2, 1).copy()
        for t in reversed(range(time)):
            if len(ended[t]):
                dh[ended[t]] = 0
            own = through[:, t]
            own *= dh
            by_c[t] *= dh
            np.matmul(own, turned, out=part)
            dh *= z[t]
            for k in range(3):
                dh += part[k]
            dh += back[t]
        np.matmul(states.reshape(-1, n).T, through.reshape(3, -1, n), out=g["u"])
        inward = self.room("inputs", len(flat), n)
        for k, by_input in enumerate((by_r, by_z, by_c)):
            _sum_by(targets, np.take(by_input.reshape(-1, n), order, axis=0, out=inward, mode="clip"), g["x"][k])
        return g, last

    def train(self, documents: list[np.ndarray], streams: int = 512, window: int = 20, rate: float = 0.03) -> int:
        """One pass of Adam over documents (symbols, each with its end), end to end and cut into streams
        of equal length: as many as `streams`, or fewer where that would leave under 100 windows. The
        last stream is filled up with the first symbols."""
        flat = np.concatenate(documents) if documents else np.zeros(0, np.int64)
        streams = int(np.clip(len(flat) // (100 * window), min(8, max(1, len(flat) // 2)), streams))
        length = -(-len(flat) // streams)
        if length < 2:
            return 0
        ids = np.resize(flat, (streams, length)).T
        state = np.zeros((streams, self.hidden), np.float32)
        vector = self.vector()
        self.view(vector)
        m, v, rise = np.zeros_like(vector), np.zeros_like(vector), np.empty_like(vector)
        for step, t in enumerate(range(0, length, window), 1):
            g, state = self.gradients(ids[t : t + window], state)
            grad = np.concatenate([g[n].ravel() for n in self.NAMES])
            grad *= np.float32(1 / max(1.0, float(np.sqrt(grad @ grad))))
            m *= np.float32(0.9)
            m += np.multiply(grad, np.float32(0.1), out=rise)
            v *= np.float32(0.99)
            grad *= grad
            grad *= np.float32(0.01)
            v += grad
            np.multiply(v, np.float32(1 / (1 - 0.99**step)), out=rise)
            np.sqrt(rise, out=rise)
            rise += np.float32(1e-6)
            np.divide(m, rise, out=rise)
            rise *= np.float32(rate / (1 - 0.9**step))
            vector -= rise
        return length * streams

    def score(self, documents: list[np.ndarray], streams: int = 512, window: int = 32) -> np.ndarray:
        """log10 probability of each whole document (symbols with the end). Documents are put end to
        end into streams of about equal length, which run side by side: an end resets the state, so
        each starts anew. States are carried from window to window."""
        totals = np.zeros(len(documents))
        loads = [(0, k) for k in range(min(streams, len(documents)))]
        members: list[list[int]] = [[] for _ in loads]
        for k in sorted(range(len(documents)), key=lambda k: -len(documents[k])):
            load, at = loads[0]
            members[at].append(k)
            heapq.heapreplace(loads, (load + len(documents[k]), at))
        loads.sort(reverse=True)
        order = [k for _, at in loads for k in members[at]]
        sizes = np.array([load for load, _ in loads], np.int64)
        flat = np.concatenate([documents[k] for k in order]) if order else np.zeros(0, np.int32)
        starts = np.cumsum(sizes) - sizes
        h, logs = np.zeros((len(sizes), self.hidden), np.float32), np.zeros(len(flat), np.float32)
        for t in range(0, int(sizes.max(initial=0)), window):
            active = int(np.searchsorted(-sizes, -t))
            left = np.minimum(sizes[:active] - t, window)
            width = np.arange(int(left.max()))[:, None]
            at = starts[:active] + t + width
            whole = left[-1] == len(width)  # streams are ordered by length
            inside = ... if whole else width < left
            ids = flat[at] if whole else np.where(inside, flat[np.where(inside, at, 0)], self.end)
            states, h, _ = self.steps(ids, h[:active], keep=False)
            states = states.reshape(-1, self.hidden) if whole else states[inside]
            logs[at[inside].reshape(-1)] = self.log_probs(states, ids[inside].reshape(-1))
        if order:
            lengths = np.array([len(documents[k]) for k in order])
            totals[order] = np.add.reduceat(logs, np.cumsum(lengths) - lengths, dtype=np.float64)
        return totals / np.log(10)
