"""A small causal self-attention model over subword ids, in numpy.

The next id is predicted in two steps: its class from the context by attention, and the id within
its class from counts. Classes are made of ids of similar frequency with about equal mass, so that
frequent ids stand alone; counts come from the whole corpus. The probabilities of all ids add up
to one in every context.

Texts are read in overlapping windows: the first scores all its ids, each further one the last
`STRIDE`, for which the ids before them in the window are context. Every id is scored once.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from math import prod

import numpy as np

#: Positions of a window and how many of them a further window scores.
WINDOW, STRIDE = 24, 20
#: Width of the model and of its inner layer.
WIDTH, INNER = 16, 16
#: Classes of ids; frequent ids with an input vector of their own (others share their class's).
CLASSES, OWN_INPUT = 96, 1_024
#: Windows of a training step and of a scoring block.
STEP, BLOCK = 64, 128


@dataclass
class Vocabulary:
    """Classes and input slots of ids, from counts."""

    of_class: np.ndarray
    slot: np.ndarray
    #: Natural logarithm of an id's share of its class.
    within: np.ndarray
    #: Logarithm of each class's share.
    prior: np.ndarray
    n_slots: int


def vocabulary(counts: np.ndarray) -> Vocabulary:
    """From counts per id; one is added to each, so that unseen ids have a probability."""
    mass = counts.astype(np.float64) + 1
    order = np.argsort(-mass, kind="stable")
    before = np.cumsum(mass[order]) - mass[order]
    of_class = np.empty(len(mass), np.int32)
    of_class[order] = np.unique(np.floor(before / mass.sum() * CLASSES).astype(np.int64), return_inverse=True)[1]
    total = np.bincount(of_class, mass)
    slot = OWN_INPUT + of_class
    slot[order[:OWN_INPUT]] = np.arange(min(OWN_INPUT, len(mass)))
    return Vocabulary(of_class, slot.astype(np.int32), np.log(mass / total[of_class]).astype(np.float32), np.log(total / total.sum()), OWN_INPUT + len(total) + 1)


def shapes(v: Vocabulary) -> dict[str, tuple[int, ...]]:
    d, c = WIDTH, len(v.prior)
    # one head as wide as the model: "match" is queries times keys, "value" values times output
    return {"slots": (v.n_slots, d), "places": (WINDOW, d), "match": (d, d), "value": (d, d), "w1": (d, INNER), "b1": (INNER,), "w2": (INNER, d), "out": (d, c), "bias": (c,)}


def untrained(v: Vocabulary, seed: int = 42) -> dict[str, np.ndarray]:
    """Weights that predict the classes' shares whatever the context."""
    draw, made = np.random.default_rng(seed), {}
    for name, shape in shapes(v).items():
        scale = {"slots": 0.5, "places": 0.1, "b1": 0.0, "out": 0.05}.get(name, WIDTH**-0.5)
        made[name] = (draw.standard_normal(shape) * scale).astype(np.float32)
    made["bias"] = v.prior.astype(np.float32)
    return made


def flat(weights: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([w.ravel() for w in weights.values()])


def shaped(v: Vocabulary, numbers: np.ndarray) -> dict[str, np.ndarray]:
    made, at = {}, 0
    for name, shape in shapes(v).items():
        size = int(np.prod(shape))
        made[name] = np.ascontiguousarray(numbers[at : at + size].reshape(shape), np.float32)
        at += size
    return made


def windows(begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows over texts that lie in a row: each one's first position, the end of its text, and
    its number within the text."""
    sizes = np.diff(begins)
    count = np.where(sizes > 0, 1 + np.maximum(0, -(-(sizes - WINDOW) // STRIDE)), 0)
    number = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    return np.repeat(begins[:-1], count) + number * STRIDE, np.repeat(begins[1:], count), number


def inputs(v: Vocabulary, ids: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The input slot that each id is predicted from: its predecessor's, or the beginning's."""
    before = np.empty(len(ids), np.int32)
    before[1:] = v.slot[ids[:-1]]
    before[begins[:-1][np.diff(begins) > 0]] = v.n_slots - 1
    return before


#: No position sees a later one.
SEEN = np.tril(np.ones((WINDOW, WINDOW), np.float32))


class Room:
    """Arrays by name that are used again from one step to the next: the system takes longer to hand
    out fresh ones of this size than the sums in them take."""

    def __init__(self):
        self.held: dict[str, np.ndarray] = {}

    def __call__(self, name: str, shape: tuple[int, ...], kind: np.dtype) -> np.ndarray:
        size, held = prod(shape), self.held.get(name)
        if held is None or held.dtype != kind or held.size < size:
            held = self.held[name] = np.empty(size, kind)
        return held[:size].reshape(shape)


def _flat(t: np.ndarray) -> np.ndarray:
    return t.reshape(-1, t.shape[-1])


def attended(w: dict[str, np.ndarray], slots: np.ndarray, room: Room, since: int = 0) -> tuple:
    """Vectors behind the attention of windows of input slots, for the positions from `since` on (all of
    a window's are looked at), and what the gradient needs. They lie in `room` and hold until it is used again."""
    kind, shape, n = w["slots"].dtype, (*slots.shape, WIDTH), slots.size
    x = np.take(w["slots"], slots, 0, out=room("x", shape, kind), mode="clip")
    x += w["places"]
    # what a position asks and what it holds, side by side
    both = np.matmul(_flat(x), _match_and_value(w), out=room("both", (n, 2 * WIDTH), kind)).reshape(*slots.shape, 2 * WIDTH)
    asked, held = both[:, :, :WIDTH], both[:, :, WIDTH:]
    scores = np.matmul(asked[:, since:], _turned(x, room), out=room("scores", (len(slots), WINDOW - since, WINDOW), kind))
    a, total = _weighed(scores, SEEN[since:], room("a", scores.shape, kind))
    a *= 1 / total
    h = np.matmul(a, held, out=room("h", (len(slots), WINDOW - since, WIDTH), kind))
    h += x[:, since:]
    return h, (x, asked, a, held)


def _match_and_value(w: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([w["match"] * w["match"].dtype.type(WIDTH**-0.5), w["value"]], 1)


def _turned(t: np.ndarray, room: Room) -> np.ndarray:
    """Every window's matrix transposed and laid out anew: products with it are quicker than with a view."""
    out = room("turned", (len(t), t.shape[2], t.shape[1]), t.dtype)
    np.copyto(out, t.transpose(0, 2, 1))
    return out


def last_layer(w: dict[str, np.ndarray], h: np.ndarray, room: Room) -> tuple[np.ndarray, np.ndarray]:
    """Last layer's vectors of rows of attended ones, with a one behind each for the bias, and the inner layer's."""
    inner = np.matmul(h, w["w1"], out=room("inner", (len(h), INNER), h.dtype))
    inner += w["b1"]
    np.maximum(inner, 0, out=inner)
    top = room("top", (len(h), WIDTH + 1), h.dtype)
    np.add(np.matmul(inner, w["w2"], out=room("part", h.shape, h.dtype)), h, out=top[:, :WIDTH])
    top[:, WIDTH] = 1
    return top, inner


def hidden(w: dict[str, np.ndarray], slots: np.ndarray, room: Room | None = None) -> tuple:
    """Last layer's vectors of windows of input slots, and the inner layer's. They lie in `room` and hold
    until it is used again."""
    room = room or Room()
    top, inner = last_layer(w, _flat(attended(w, slots, room)[0]), room)
    return top[:, :WIDTH].reshape(*slots.shape, WIDTH), inner


def _weighed(scores: np.ndarray, seen: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials of the positions that are seen, in `a`, and their sums. Scores are small, so the
    largest is taken off only where a sum is not finite."""
    with np.errstate(over="ignore", invalid="ignore"):
        np.exp(scores, out=a)
        a *= seen
        total = (_flat(a) @ np.ones(a.shape[2], a.dtype)).reshape(*a.shape[:2], 1)
    if not np.isfinite(total).all() or not total.all():
        scores = np.where(seen > 0, scores, -np.inf)
        np.exp(scores - scores.max(2, keepdims=True), out=a)
        total = a.sum(2, keepdims=True)
    return a, total


def _masses(w: dict[str, np.ndarray], top: np.ndarray, targets: np.ndarray, room: Room) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows with a one behind them: the target classes' scores, exponentials of all classes' scores,
    and their sums."""
    layer = np.concatenate([w["out"], w["bias"][None]])
    scores = np.matmul(top, layer, out=room("classes", (len(top), layer.shape[1]), top.dtype))
    place, ones = np.arange(len(top)) * scores.shape[1] + targets, np.ones(scores.shape[1], top.dtype)
    at = scores.ravel()[place]
    with np.errstate(over="ignore", invalid="ignore"):
        np.exp(scores, out=scores)
        total = scores @ ones
    if not np.isfinite(total).all() or not total.all():
        np.matmul(top, layer, out=scores)
        most = scores.max(1)
        scores -= most[:, None]
        np.exp(scores, out=scores)
        at, total = at - most, scores @ ones
    return at, scores, total


def class_log_probabilities(w: dict[str, np.ndarray], vectors: np.ndarray, targets: np.ndarray, keep: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Log probability of each target class; with `keep` also all classes' probabilities."""
    at, masses, total = _masses(w, np.concatenate([vectors, np.ones((len(vectors), 1), vectors.dtype)], 1), targets, Room())
    return at - np.log(total), masses / total[:, None] if keep else None


@lru_cache(maxsize=2)
def _places(n_slots: int) -> np.ndarray:
    """Where each slot's numbers lie among those of all slots."""
    return np.arange(n_slots * WIDTH).reshape(n_slots, WIDTH)


def _at_scored(h: np.ndarray, scored: np.ndarray, room: Room) -> tuple[np.ndarray, np.ndarray]:
    """Places of the scored positions, and their vectors: only these go through the last layer."""
    places = np.flatnonzero(scored)
    return places, np.take(_flat(h), places, 0, out=room("rows", (len(places), WIDTH), h.dtype), mode="clip")


def gradient(w: dict[str, np.ndarray], slots: np.ndarray, targets: np.ndarray, scored: np.ndarray, room: Room | None = None) -> tuple[float, dict[str, np.ndarray]]:
    """Mean loss over the scored positions of windows, and its gradient."""
    room = room or Room()
    h, (x, asked, a, held) = attended(w, slots, room)
    kind, shape, n = x.dtype, x.shape, slots.size
    places, rows = _at_scored(h, scored, room)
    top, inner = last_layer(w, rows, room)
    of, ones = targets.ravel()[places], np.ones(max(n, len(places)), kind)
    at, p, mass = _masses(w, top, of, room)
    loss = float((np.log(mass) - at).sum()) / len(of)
    # masses stay as they are: what they are divided by goes to the narrow factors of their products
    p.ravel()[np.arange(len(of)) * p.shape[1] + of] -= mass
    share = 1 / (mass * kind.type(len(of)))
    d_top = np.matmul(p, w["out"].T, out=room("d_top", rows.shape, kind))
    d_top *= share[:, None]
    top *= share[:, None]
    g = {"out": (p.T @ top[:, :WIDTH]).T, "bias": share @ p, "w2": inner.T @ d_top}
    d_inner = np.matmul(d_top, w["w2"].T, out=room("d_inner", inner.shape, kind))
    d_inner *= inner > 0
    g["w1"], g["b1"] = rows.T @ d_inner, ones[: len(of)] @ d_inner
    d_top += np.matmul(d_inner, w["w1"].T, out=room("part", rows.shape, kind))
    d_h = room("d_h", (n, WIDTH), kind)
    d_h.fill(0)
    d_h[places] = d_top
    d_h = d_h.reshape(shape)
    d_s = np.matmul(d_h, _turned(held, room), out=room("d_s", a.shape, kind))
    h -= x  # the weighed values alone: their product with d_h is the sum of d_s weighed by a
    d_s -= np.einsum("bij,bij->bi", d_h, h)[:, :, None]
    d_s *= a
    d_both = room("d_both", (*slots.shape, 2 * WIDTH), kind)
    np.matmul(d_s, x, out=d_both[:, :, :WIDTH])
    np.matmul(a.transpose(0, 2, 1), d_h, out=d_both[:, :, WIDTH:])
    of_both, part = _flat(x).T @ _flat(d_both), room("part", (n, WIDTH), kind)
    g["match"], g["value"] = of_both[:, :WIDTH] * kind.type(WIDTH**-0.5), of_both[:, WIDTH:]
    d_x = _flat(d_h)
    d_x += np.matmul(_flat(d_both), _match_and_value(w).T, out=part)
    d_x += _flat(np.matmul(d_s.transpose(0, 2, 1), asked, out=part.reshape(shape)))
    g["places"] = (ones[: len(slots)] @ d_x.reshape(len(slots), -1)).reshape(shape[1:])
    # rows of one slot are added up number by number, by where the slot's numbers lie in the weights
    lie = np.take(_places(len(w["slots"])), slots.ravel(), 0, out=room("lie", (n, WIDTH), np.dtype(np.intp)), mode="clip")
    g["slots"] = np.bincount(lie.ravel(), d_x.ravel(), w["slots"].size).reshape(w["slots"].shape)
    return loss, {name: g[name].astype(np.float32, copy=False) for name in w}


class Learner:
    """Adam over the windows it is given, in steps of `STEP` windows."""

    def __init__(self, v: Vocabulary, weights: np.ndarray, rate: float = 3e-3):
        self.numbers = np.array(weights, np.float32)
        self.v, self.w, self.rate, self.room = v, shaped(v, self.numbers), rate, Room()  # w: views of the numbers
        self.m, self.s = np.zeros_like(self.numbers), np.zeros_like(self.numbers)
        self.steps = self.seen = 0
        #: Windows that did not fill a step yet.
        self.rest: list[np.ndarray] = []

    def add(self, ids: np.ndarray, begins: np.ndarray, first: np.ndarray, end: np.ndarray, number: np.ndarray) -> None:
        """Learn from windows as far as they fill steps; only a step's are laid out at a time."""
        before, classes = inputs(self.v, ids, begins), self.v.of_class[ids]
        done = 0
        while done < len(first):
            to = done + STEP - (len(self.rest[0]) if self.rest else 0)
            at = first[done:to, None] + np.arange(WINDOW)
            scored = at < end[done:to, None]
            scored &= (number[done:to] == 0)[:, None] | (np.arange(WINDOW) >= WINDOW - STRIDE)
            np.minimum(at, len(ids) - 1, out=at)
            some = [before[at], classes[at], scored]
            self.rest = [np.concatenate(parts) for parts in zip(self.rest, some)] if self.rest else some
            done = to
            if len(self.rest[0]) == STEP:
                self.learn(True)

    def learn(self, last: bool) -> None:
        """With `last`, a step of the windows that are left, however few."""
        if last and self.rest:
            self._step(*self.rest)
            self.rest = []

    def _step(self, slots: np.ndarray, targets: np.ndarray, scored: np.ndarray) -> None:
        g = flat(gradient(self.w, slots, targets, scored, self.room)[1])
        self.steps += 1
        self.seen += int(np.count_nonzero(scored))
        rate = self.rate * (1 - 0.999**self.steps) ** 0.5 / (1 - 0.9**self.steps)
        part = self.room("adam", g.shape, g.dtype)
        np.subtract(g, self.m, out=part)
        part *= 0.1
        self.m += part
        g *= g
        g -= self.s
        g *= 0.001
        self.s += g
        np.sqrt(self.s, out=part)
        part += 1e-8
        np.multiply(self.m, rate, out=g)
        g /= part
        self.numbers -= g


def score(v: Vocabulary, w: dict[str, np.ndarray], ids: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Natural log probability of every text of ids that lie in a row; 0 for a text without ids."""
    before, total = inputs(v, ids, begins), np.zeros(len(ids), np.float64)
    first, end, number = windows(begins)
    room = Room()
    # further windows only ask from where they score
    for since, which in ((0, np.flatnonzero(number == 0)), (WINDOW - STRIDE, np.flatnonzero(number))):
        for i in range(0, len(which), BLOCK):
            some = which[i : i + BLOCK]
            at = first[some, None] + np.arange(WINDOW)
            scored = at[:, since:] < end[some, None]
            h, _ = attended(w, before[np.minimum(at, len(ids) - 1)], room, since)
            of, rows = _at_scored(h, scored, room)
            places = at[:, since:].ravel()[of]
            held = ids[places]
            found, _, mass = _masses(w, last_layer(w, rows, room)[0], v.of_class[held], room)
            total[places] = found - np.log(mass) + v.within[held]
    summed = np.concatenate([[0.0], np.cumsum(total)])
    return summed[begins[1:]] - summed[begins[:-1]]
