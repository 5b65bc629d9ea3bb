"""Gated recurrent language model in NumPy with a class-factored softmax.

The output symbols are split into equal classes: a symbol's probability is that of its class
times that within the class, so a token costs two short softmaxes. Documents run side by side in
lanes; the state of a lane is carried from window to window until its document ends. Training
back-propagates within a window (truncated back-propagation through time).
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np

WINDOW = 32
LANES = 256
#: Training cuts longer documents into so many symbols, each a lane of its own.
TRAIN_PIECE = 4096
#: Symbols of a document that a lane holds at a time.
STRETCH = 1024
LEARNING_RATE = 0.01
CLIP = 1.0
#: Single-precision exponentials of such numbers neither overflow nor vanish.
SAFE = 75.0

PARTS = ("inputs", "recur", "bias", "class_w", "class_b", "word_w", "word_b")

Weights = dict[str, np.ndarray]


def shapes(classes: int, members: int, width: int) -> dict[str, tuple[int, ...]]:
    """``inputs`` has one row more than there are symbols: the one before the first token."""
    return {
        "inputs": (classes * members + 1, 3 * width), "recur": (width, 3 * width), "bias": (3 * width,),
        "class_w": (width, classes), "class_b": (classes,), "word_w": (classes, members, width), "word_b": (classes, members),
    }


def start_weights(masses: np.ndarray, classes: int, width: int, seed: int) -> Weights:
    """Small random weights; the biases give the symbols' own frequencies."""
    rng = np.random.default_rng(seed)
    members = len(masses) // classes
    weights = {}
    for name, shape in shapes(classes, members, width).items():
        scale = 0.0 if name.endswith(("bias", "_b", "_w")) else 0.5 if name == "inputs" else 1 / np.sqrt(width)
        weights[name] = (rng.standard_normal(shape) * scale).astype(np.float32)
    logs = np.log(masses / masses.sum()).reshape(classes, members)
    top = logs.max(axis=1)
    total = top + np.log(np.exp(logs - top[:, None]).sum(axis=1))
    weights["class_b"] = total.astype(np.float32)
    weights["word_b"] = (logs - total[:, None]).astype(np.float32)
    return weights


def pack(weights: Weights) -> np.ndarray:
    return np.concatenate([weights[name].ravel() for name in PARTS])


def unpack(flat: np.ndarray, classes: int, members: int, width: int) -> Weights:
    weights, at = {}, 0
    for name, shape in shapes(classes, members, width).items():
        size = int(np.prod(shape))
        weights[name] = flat[at : at + size].reshape(shape)
        at += size
    return weights


@dataclass
class Windows:
    """The next window of every lane at work: ``symbols`` and ``inside`` are ``(WINDOW, lanes)``."""

    symbols: np.ndarray
    before: np.ndarray
    inside: np.ndarray
    fresh: np.ndarray
    owner: list[int]
    lanes: np.ndarray


def windows(documents: Iterable[tuple[int, np.ndarray]], start_symbol: int) -> Iterator[Windows]:
    """Cut ``(owner, symbols)`` into windows. At most ``LANES`` documents are held at a time.

    A lane holds a stretch of its document, the symbol before it first, so that a window is taken from all lanes at once.
    """
    source = iter(documents)
    stretch = max(1, STRETCH // WINDOW) * WINDOW
    owner = np.full(LANES, -1)
    texts = [np.zeros(0, np.int32)] * LANES
    begin = [0] * LANES
    held = np.zeros((LANES, stretch + WINDOW + 1), np.int32)
    at, end = np.zeros(LANES, np.int64), np.zeros(LANES, np.int64)
    open_lanes = np.ones(LANES, bool)
    steps = np.arange(WINDOW + 1)[:, None]
    while True:
        fresh = np.zeros(LANES, bool)
        for lane in np.flatnonzero((at >= end) & open_lanes).tolist():
            text = texts[lane]
            begin[lane] += stretch
            if begin[lane] >= len(text):
                found = next((f for f in source if len(f[1])), None)
                if found is None:
                    open_lanes[lane] = False
                    continue
                owner[lane], text = found
                texts[lane], begin[lane], fresh[lane] = text, 0, True
            first = begin[lane]
            piece = text[first : first + stretch]
            held[lane, 0] = text[first - 1] if first else start_symbol
            held[lane, 1 : len(piece) + 1] = piece
            at[lane], end[lane] = 0, len(piece)
        lanes = np.flatnonzero(open_lanes)
        if not len(lanes):
            return
        sizes = np.minimum(end[lanes] - at[lanes], WINDOW)
        n = int(sizes.max())
        # what a lane gives beyond its end is not inside
        picked = np.take(held, at[lanes] + lanes * held.shape[1] + steps[: n + 1])
        at[lanes] += sizes
        yield Windows(picked[1:], picked[:-1], steps[:n] < sizes, fresh[lanes], owner[lanes].tolist(), lanes)


def _exponentials(x: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials of each column up to a factor, in the place of ``x``, and their sums. ``reach`` bounds every ``abs(x)``."""
    if reach > SAFE:
        x -= x.max(axis=0)
    np.exp(x, out=x)
    return x, np.ones(len(x), x.dtype) @ x


@dataclass
class Trace:
    """A window step by step, each ``(steps, width, lanes)``; ``states`` has one step more, ``gates`` both gates, ``recalled`` all three parts."""

    states: np.ndarray
    gates: np.ndarray
    new: np.ndarray
    recalled: np.ndarray


@dataclass
class Targets:
    """The symbols of a window in order of their class.

    ``at`` are their places in the flat window, ``states`` ``(width + 1, symbols)`` what predicts them, the
    last row ones for the biases, and ``spans`` ``(class, begin, end)``.
    """

    at: np.ndarray
    kind: np.ndarray
    member: np.ndarray
    states: np.ndarray
    spans: list[tuple[int, int, int]]


class Network:
    """Inside of a window, one column is one lane or symbol: slices by gate are whole blocks of memory."""

    def __init__(self, weights: Weights):
        self.weights = {name: np.array(weights[name]) for name in PARTS}
        self.width = self.weights["recur"].shape[0]
        self.classes, self.members = self.weights["word_b"].shape
        self.kind = self.weights["recur"].dtype
        self.state = np.zeros((self.width, LANES), self.kind)
        self.moments = {name: (np.zeros_like(v), np.zeros_like(v)) for name, v in self.weights.items()}
        self.steps = 0
        self.rooms: dict[str, np.ndarray] = {}
        self.ready: tuple | None = None

    def _room(self, name: str, *shape: int) -> np.ndarray:
        """Memory that is taken again by each window; what it held before is lost."""
        size = math.prod(shape)
        if name not in self.rooms or len(self.rooms[name]) < size:
            self.rooms[name] = np.empty(size, self.kind)
        return self.rooms[name][:size].reshape(shape)

    @property
    def start_symbol(self) -> int:
        return self.classes * self.members

    def _run(self, batch: Windows) -> Trace:
        """States of a window; the lanes' states move on."""
        w, h = self.weights, self.width
        steps, lanes = batch.before.shape
        sizes = {"states": (steps + 1, h), "gates": (steps, 2 * h), "new": (steps, h), "recalled": (steps, 3 * h)}
        trace = Trace(*(self._room(name, *size, lanes) for name, size in sizes.items()))
        state = trace.states[0]
        state[:] = self.state[:, batch.lanes]
        state[:, batch.fresh] = 0
        inputs, recur = self._ready()[:2]
        gates_in = self._room("gates_in", 3 * h, steps, lanes)
        np.take(inputs, batch.before, axis=1, out=gates_in, mode="clip")
        for step in range(steps):
            x = gates_in[:, step]
            u = np.matmul(recur, state, out=trace.recalled[step])
            gate, new, after = trace.gates[step], trace.new[step], trace.states[step + 1]
            np.add(x[: 2 * h], u[: 2 * h], out=gate)
            np.negative(gate, out=gate)
            np.exp(gate, out=gate)
            gate += 1
            np.reciprocal(gate, out=gate)
            np.multiply(gate[h:], u[2 * h :], out=new)
            new += x[2 * h :]
            np.tanh(new, out=new)
            np.subtract(state, new, out=after)
            after *= gate[:h]
            after += new
            state = after
        self.state[:, batch.lanes] = state
        return trace

    def _ready(self) -> tuple:
        """The weights as the windows use them, until the next step: the biases are columns of the outer layers.

        The last two bound the class and word scores; a state lies between -1 and 1.
        """
        if self.ready is None:
            w = self.weights
            inputs = np.ascontiguousarray((w["inputs"] + w["bias"]).T)
            of_class = np.vstack([w["class_w"], w["class_b"]]).T.copy()
            of_word = np.concatenate([w["word_w"], w["word_b"][:, :, None]], axis=2)
            reaches = (float(np.abs(layer).sum(axis=-1).max()) for layer in (of_class, of_word))
            self.ready = (inputs, w["recur"].T.copy(), of_class, of_word, *reaches)
        return self.ready

    def _targets(self, batch: Windows, trace: Trace) -> Targets:
        places = np.flatnonzero(batch.inside)
        kind, member = np.divmod(batch.symbols.ravel()[places], self.members)
        order = np.argsort(kind.astype(np.int16), kind="stable")
        at, kind, member = places[order], kind[order], member[order]
        # the state before a token predicts it, and includes the token before it
        flat = self._room("flat_states", self.width, *batch.inside.shape)
        flat[:] = trace.states[1:].transpose(1, 0, 2)
        states = self._room("targets", self.width + 1, len(at))
        np.take(flat.reshape(self.width, -1), at, axis=1, out=states[:-1], mode="clip")
        states[-1] = 1
        ends = np.cumsum(np.bincount(kind, minlength=self.classes)).tolist()
        spans = [(k, begin, end) for k, (begin, end) in enumerate(zip([0, *ends], ends)) if end > begin]
        return Targets(at, kind, member, states, spans)

    def _softmax(self, name: str, layer: np.ndarray, states: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
        return _exponentials(np.matmul(layer, states, out=self._room(name, len(layer), states.shape[1])), reach)

    def log_probs(self, batch: Windows) -> np.ndarray:
        """Natural log probability of each symbol of the window, 0 outside of documents."""
        _, _, of_class, of_word, class_reach, word_reach = self._ready()
        goal = self._targets(batch, self._run(batch))
        every = np.arange(len(goal.at))
        likely, sums = self._softmax("of_class", of_class, goal.states, class_reach)
        chances = likely[goal.kind, every] / sums
        scores = np.log(chances)
        for k, begin, end in goal.spans:
            likely, sums = self._softmax("of_word", of_word[k], goal.states[:, begin:end], word_reach)
            np.divide(likely[goal.member[begin:end], every[: end - begin]], sums, out=chances[begin:end])
        scores += np.log(chances)
        out = np.zeros(batch.inside.shape, np.float64)
        out.ravel()[goal.at] = scores
        return out

    def learn(self, batch: Windows) -> None:
        """One step of Adam on the window."""
        w, h = self.weights, self.width
        steps, lanes = batch.before.shape
        _, _, of_class, of_word, class_reach, word_reach = self._ready()
        trace = self._run(batch)
        goal = self._targets(batch, trace)
        every = np.arange(len(goal.at))
        grads = {}

        error, sums = self._softmax("of_class", of_class, goal.states, class_reach)
        error /= sums
        error[goal.kind, every] -= 1
        slopes = goal.states @ error.T
        grads["class_w"], grads["class_b"] = slopes[:h], slopes[h]
        into = np.matmul(w["class_w"], error, out=self._room("into", h, len(goal.at)))
        slopes = np.zeros_like(of_word)
        for k, begin, end in goal.spans:
            local = goal.states[:, begin:end]
            error, sums = self._softmax("of_word", of_word[k], local, word_reach)
            error /= sums
            error[goal.member[begin:end], every[: end - begin]] -= 1
            slopes[k] = error @ local.T
            into[:, begin:end] += w["word_w"][k].T @ error
        grads["word_w"], grads["word_b"] = slopes[:, :, :h].copy(), slopes[:, :, h].copy()

        back = self._room("back", h, steps * lanes)
        back[:] = 0
        back[:, goal.at] = into
        back = back.reshape(h, steps, lanes)
        z, r, before = trace.gates[:, :h], trace.gates[:, h:], trace.states[:-1]
        by_new, by_z, by_r, gate_errors = (self._room(name, steps, h, lanes) for name in ("by_new", "by_z", "by_r", "gate_errors"))
        state_errors = self._room("state_errors", steps, 3 * h, lanes)
        # by_z: (before - new) z (1 - z); by_new: (1 - z) (1 - new new); by_r: recalled r (1 - r)
        np.subtract(before, trace.new, out=by_z)
        by_z *= z
        np.subtract(1, z, out=by_r)
        by_z *= by_r
        np.multiply(trace.new, trace.new, out=by_new)
        np.subtract(1, by_new, out=by_new)
        by_new *= by_r
        np.subtract(1, r, out=by_r)
        by_r *= r
        by_r *= trace.recalled[:, 2 * h :]
        carried = np.zeros((h, lanes), self.kind)
        for step in range(steps - 1, -1, -1):
            carried += back[:, step]
            d_new, d_u = gate_errors[step], state_errors[step]
            np.multiply(carried, by_new[step], out=d_new)
            np.multiply(carried, by_z[step], out=d_u[:h])
            np.multiply(d_new, by_r[step], out=d_u[h : 2 * h])
            np.multiply(d_new, r[step], out=d_u[2 * h :])
            carried *= z[step]
            carried += w["recur"] @ d_u
        grads["recur"] = np.matmul(before, state_errors.transpose(0, 2, 1)).sum(axis=0)
        state_errors[:, 2 * h :] = gate_errors
        flat = self._room("flat_errors", 3 * h, steps, lanes)
        flat[:] = state_errors.transpose(1, 0, 2)
        flat, used = flat.reshape(3 * h, -1), batch.before.ravel().astype(np.int64)
        grads["bias"] = flat.sum(axis=1)
        grads["inputs"] = np.empty_like(w["inputs"])
        for row in range(3 * h):
            grads["inputs"][:, row] = np.bincount(used, flat[row], len(w["inputs"]))
        self._step(grads, len(goal.at))

    def _step(self, grads: Weights, n: int) -> None:
        """Adam; a window with few symbols takes a step that is shorter in proportion."""
        self.steps += 1
        self.ready = None
        full = WINDOW * LANES
        scale = 1 / n
        norm = math.sqrt(sum(float(np.vdot(g, g)) for g in grads.values())) * scale
        scale *= min(1.0, CLIP / max(norm, 1e-12))
        # Python's own numbers leave the arrays in single precision
        rate = LEARNING_RATE * n / full * math.sqrt(1 - 0.99**self.steps) / (1 - 0.9**self.steps)
        for name, grad in grads.items():
            grad *= scale
            mean, square = self.moments[name]
            move = self._room("move", *grad.shape)
            np.subtract(grad, mean, out=move)
            move *= 0.1
            mean += move
            grad *= grad
            grad -= square
            grad *= 0.01
            square += grad
            np.sqrt(square, out=grad)
            grad += 1e-6
            np.divide(mean, grad, out=move)
            move *= rate
            self.weights[name] -= move


def train(weights: Weights, texts: Iterable[np.ndarray]) -> tuple[Weights, int]:
    """One pass over all ``texts``; the new weights and the number of symbols learned from."""
    network, n = Network(weights), 0
    pieces = ((0, text[at : at + TRAIN_PIECE]) for text in texts for at in range(0, len(text), TRAIN_PIECE))
    for batch in windows(pieces, network.start_symbol):
        network.learn(batch)
        n += int(batch.inside.sum())
    return network.weights, n


def score(weights: Weights, documents: Iterable[tuple[int, np.ndarray]]) -> Iterator[tuple[int, float]]:
    """``(owner, natural log probability)`` pieces of the whole documents; add them up by owner."""
    network = Network(weights)
    for batch in windows(documents, network.start_symbol):
        yield from zip(batch.owner, network.log_probs(batch).sum(axis=0).tolist(), strict=True)
