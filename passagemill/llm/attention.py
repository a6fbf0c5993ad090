"""A causal self-attention language model over subword ids, in numpy. No Spark in here.

Ids are ranked by their count. The model gives the next id in two steps from one hidden state: a softmax over the ``SINGLES`` most frequent ids, ``GROUPS`` groups of those
that follow and one class of all others, and in a group a softmax over its ids. Groups grow with the rank, so that some 7,000 ids are told apart by the model; only
within the last class an id has its smoothed corpus frequency. The probabilities of all ids sum to one after any context.

One layer: an attention over the ids before a token (keys, queries and values are look-ups of ids, places are relative) and the two last ids themselves go
through a tanh layer, the hidden state. Texts are cut into blocks of ``BLOCK`` tokens; a block sees itself, causally, and the ``CONTEXT`` tokens before it, so windows
overlap and each token is scored once. Many blocks are computed at once; a mask hides the future and what lies outside a text.
"""

from __future__ import annotations

import numpy as np

BLOCK, CONTEXT = 24, 16
SPAN = BLOCK + CONTEXT
SINGLES, GROUPS, GROWTH = 48, 15, 1.42
FIRST = SINGLES + GROUPS + 1
#: Ids with input rows of their own; all rarer ones share a row, and the start of a text has one.
ROWS = 1024
START = ROWS
QUERY, VALUE, HIDDEN = 8, 16, 24
#: How far each query of a block is from each key of its window; keys from the future are masked.
DISTANCE = np.arange(CONTEXT, SPAN)[:, None] - np.arange(SPAN)[None, :]
TINY = np.float32(1e-30)  # keeps logarithms finite
FUTURE = np.where(DISTANCE < 0, np.float32(-1e9), np.float32(0))
NEAR = np.maximum(DISTANCE, 0)
HIGHEST = np.float32(40)  # of an attention weight's logarithm, and half that of a class's: exp can't overflow


class Ranks:
    """What the counts of ids decide: input row, first-step class, and place in its group, of each id."""

    def __init__(self, counts: np.ndarray):
        n = len(counts)
        order = np.argsort(-counts, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        sizes = np.rint(16 * GROWTH ** np.arange(GROUPS)).astype(np.int64)
        self.edges = np.minimum(np.cumsum([SINGLES, *sizes]), n)
        group = np.searchsorted(self.edges, rank, side="right") - 1  # -1 for singles, GROUPS for the last class
        self.first = np.where(group < 0, rank, SINGLES + group).astype(np.int16)
        self.place = np.where((group >= 0) & (group < GROUPS), rank - self.edges[group], 0).astype(np.int32)
        self.row = np.minimum(rank, ROWS - 1).astype(np.int16)
        smoothed = counts + 0.5
        self.share = np.bincount(self.first, smoothed, FIRST)
        self.inside = np.where(self.first == FIRST - 1, np.log(smoothed / self.share[self.first]), 0).astype(np.float32)
        self.frequency = np.log(smoothed[order] / self.share[self.first[order]]).astype(np.float32)[SINGLES : self.edges[-1]]  # in the groups
        self.columns = self.edges - SINGLES  # of the groups in the second step's matrix


def blocks_of(sequences: list[np.ndarray], ranks: Ranks) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Input rows of the window of each block, target ids, and the text of each block.

    A text's inputs are the start and its ids but the last; its targets are its ids. Places outside a text are -1.
    """
    counts = np.array([len(s) for s in sequences], np.int64)
    blocks = -(-counts // BLOCK)
    owner = np.repeat(np.arange(len(counts)), blocks)
    flat = np.concatenate(sequences).astype(np.int32) if len(sequences) else np.zeros(0, np.int32)
    if not len(flat):
        return np.zeros((0, SPAN), np.int16), np.zeros((0, BLOCK), np.int32), owner
    first = np.cumsum(counts) - counts
    number = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    at = number[:, None] * BLOCK + np.arange(BLOCK)[None, :]
    inside = at < counts[owner][:, None]
    targets = np.where(inside, flat[np.minimum(first[owner][:, None] + at, len(flat) - 1)], -1)
    back = number[:, None] * BLOCK + np.arange(-CONTEXT, BLOCK)[None, :]  # place of an input; it is the id one before
    known = (back >= 0) & (back < counts[owner][:, None])
    inputs = np.where(known, ranks.row[flat][np.clip(first[owner][:, None] + back - 1, 0, len(flat) - 1)], np.int16(-1))
    inputs[back == 0] = START
    return inputs, targets, owner


class Model:
    #: The parameters: tables of input rows, then what is dense.
    TABLES, DENSE = ("here", "window", "before"), ("near", "mix", "out")

    def __init__(self, ranks: Ranks, seed: int = 0):
        self.ranks = ranks
        random = np.random.default_rng(seed)
        normal = lambda *shape: random.standard_normal(shape).astype(np.float32)
        self.p = {
            "here": 0.3 * normal(ROWS + 1, QUERY + HIDDEN), "window": 0.3 * normal(ROWS + 1, QUERY + VALUE + 1), "before": 0.3 * normal(ROWS + 1, HIDDEN),
            "near": (-0.15 * np.arange(SPAN)).astype(np.float32), "mix": 0.2 * normal(VALUE, HIDDEN), "out": 0.1 * normal(HIDDEN + 1, FIRST),
            "low": np.zeros((HIDDEN + 1, len(ranks.frequency)), np.float32),
        }
        self.p["window"][:, -1] = 1  # sums the weights; never changed
        self.p["out"][-1] = np.log(np.maximum(ranks.share / ranks.share.sum(), 1e-12))
        self.p["low"][-1] = ranks.frequency

    def packed(self) -> np.ndarray:
        return np.concatenate([self.p[n].reshape(-1) for n in sorted(self.p)])

    def unpack(self, flat: np.ndarray) -> Model:
        at = 0
        for n in sorted(self.p):
            size = self.p[n].size
            self.p[n] = flat[at : at + size].reshape(self.p[n].shape).astype(np.float32)
            at += size
        return self

    # -- forward ------------------------------------------------------------------------------

    def _state(self, inputs: np.ndarray, reach: float | None = None):
        """What the hidden states (a last column of ones) are made of, and they. ``reach``: :meth:`_reach`, if it is known."""
        p = self.p
        known = np.where(inputs < 0, np.int16(START), inputs)
        here, window = p["here"].take(known[:, CONTEXT:], axis=0), p["window"].take(known, axis=0)
        weights = np.matmul(here[:, :, :QUERY], window[:, :, :QUERY].transpose(0, 2, 1))
        weights += p["near"][NEAR] + FUTURE
        if len(short := np.nonzero(inputs.min(axis=1, initial=0) < 0)[0]):
            weights[short] += np.where(inputs[short] < 0, np.float32(-1e9), np.float32(0))[:, None, :]
        if (self._reach() if reach is None else reach) > HIGHEST:
            np.minimum(weights, HIGHEST, out=weights)
        np.exp(weights, out=weights)
        read = np.matmul(weights, window[:, :, QUERY:])
        total = np.maximum(read[:, :, -1:], 1e-30)
        read = read[:, :, :-1] / total
        body = read.reshape(-1, VALUE) @ p["mix"]
        body += here[:, :, QUERY:].reshape(-1, HIDDEN)
        body += p["before"].take(known[:, CONTEXT - 1 : -1], axis=0).reshape(-1, HIDDEN)
        hidden = np.ones((len(body), HIDDEN + 1), body.dtype)
        np.tanh(body, out=hidden[:, :HIDDEN])
        return known, here, window, weights, total, read, hidden

    def _reach(self) -> float:
        """No attention weight's logarithm is above this."""
        longest = [(self.p[n][:, :QUERY] ** 2).sum(axis=1).max() for n in ("here", "window")]
        return float(np.sqrt(longest[0] * longest[1]) + self.p["near"].max())

    def _shares(self, hidden: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """exp of the classes' logarithms, and their sum. Hidden states lie within 1, so columns of small absolute sum need no bound."""
        logits = hidden @ weights
        if np.abs(weights).sum(axis=0).max(initial=0) > 2 * HIGHEST:
            np.minimum(logits, 2 * HIGHEST, out=logits)
        np.exp(logits, out=logits)
        return logits, logits @ np.ones(logits.shape[1], logits.dtype)

    def _groups(self, first: np.ndarray):
        """(group, rows) of the tokens whose class is a group."""
        order = np.argsort(first, kind="stable")
        cuts = np.searchsorted(first[order], np.arange(SINGLES, FIRST))
        return [(g, order[a:b]) for g, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]

    def scores(self, inputs: np.ndarray, targets: np.ndarray, step: int = 128) -> np.ndarray:
        """Natural-log probability of each target id; 0 outside texts."""
        out, ranks = np.zeros(targets.shape, np.float32), self.ranks
        first = ranks.first[targets]
        wide = (targets >= 0) & (first >= SINGLES) & (first < FIRST - 1)
        kept, where = [], []
        reach = self._reach()
        for s in range(0, len(inputs), step):
            hidden = self._state(inputs[s : s + step], reach)[-1]
            shares, total = self._shares(hidden, self.p["out"])
            out[s : s + step] = np.log(shares[np.arange(len(total)), first[s : s + step].reshape(-1)] / total + TINY).reshape(-1, BLOCK)
            rows = np.nonzero(wide[s : s + step].reshape(-1))[0]
            kept.append(hidden[rows])
            where.append(rows + s * BLOCK)
        out += ranks.inside[targets]
        out[targets < 0] = 0
        if kept:
            hidden, where = np.concatenate(kept), np.concatenate(where)
            flat, goals = out.reshape(-1), targets.reshape(-1)[where]
            for g, rows in self._groups(ranks.first[goals]):
                shares, total = self._shares(hidden[rows], self.p["low"][:, ranks.columns[g] : ranks.columns[g + 1]])
                flat[where[rows]] += np.log(shares[np.arange(len(rows)), ranks.place[goals[rows]]] / total + TINY)
        return out

    # -- training -----------------------------------------------------------------------------

    def train(self, inputs: np.ndarray, targets: np.ndarray, rate: float = 0.01, batch: int = 192, seed: int = 0, state: dict | None = None) -> dict:
        """One pass of Adam over the blocks, in an order that the seed draws; the second step's matrix follows by adaptive gradients on the same hidden states."""
        if state is None:
            state = {"t": 0, "low": np.full(self.p["low"].shape, 1e-8, np.float32)} | {k: {n: np.zeros_like(self.p[n]) for n in self.TABLES + self.DENSE} for k in ("m", "v")}
        order = np.random.default_rng(seed).permutation(len(inputs))
        seen: list[tuple[np.ndarray, np.ndarray]] = []
        for s in range(0, len(order), batch):
            take = order[s : s + batch]
            goals = targets[take]
            dense, tables, hidden = self.gradients(inputs[take], goals)
            state["t"] += 1
            fix = np.sqrt(1 - 0.999 ** state["t"]) / (1 - 0.9 ** state["t"])
            for n, (rows, g) in ({n: (slice(None), g) for n, g in dense.items()} | tables).items():
                m, v = state["m"][n][rows], state["v"][n][rows]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                state["m"][n][rows], state["v"][n][rows] = m, v
                self.p[n][rows] -= np.float32(rate * fix) * m / (np.sqrt(v) + np.float32(1e-6))
            goals = goals.reshape(-1)
            rows = np.nonzero((goals >= 0) & (self.ranks.first[goals] >= SINGLES) & (self.ranks.first[goals] < FIRST - 1))[0]
            seen.append((hidden[rows], goals[rows]))
            if sum(len(g) for _, g in seen) > 32_768 or s + batch >= len(order):
                self._train_low(*map(np.concatenate, zip(*seen, strict=True)), state["low"])
                seen = []
        return state

    def _train_low(self, hidden: np.ndarray, goals: np.ndarray, squares: np.ndarray, rate: float = 0.05) -> None:
        for g, rows in self._groups(self.ranks.first[goals]):
            own = slice(self.ranks.columns[g], self.ranks.columns[g + 1])
            change = self.low_gradient(hidden[rows], g, self.ranks.place[goals[rows]])
            squares[:, own] += change * change
            self.p["low"][:, own] -= np.float32(rate) * change / np.sqrt(squares[:, own])

    def low_gradient(self, hidden: np.ndarray, group: int, places: np.ndarray) -> np.ndarray:
        """Of the mean loss in a group, by the group's columns."""
        shares, total = self._shares(hidden, self.p["low"][:, self.ranks.columns[group] : self.ranks.columns[group + 1]])
        shares /= total[:, None]
        shares[np.arange(len(places)), places] -= 1
        return hidden.T @ shares / np.float32(len(places))

    def gradients(self, inputs: np.ndarray, targets: np.ndarray) -> tuple[dict, dict, np.ndarray]:
        """Of the mean loss of the first step: by dense parameters, by (rows, values) of tables; and the hidden states. Scaled down to a norm of 1 at most."""
        p = self.p
        known, here, window, weights, total, read, hidden = self._state(inputs)
        goal = targets.reshape(-1)
        valid = goal >= 0
        logits, sums = self._shares(hidden, p["out"])
        scale = valid / np.float32(max(1, valid.sum()))
        logits *= (scale / sums).astype(logits.dtype)[:, None]
        logits[np.arange(len(goal)), self.ranks.first[goal]] -= scale
        dense = {"out": hidden.T @ logits}
        body = logits @ p["out"][:HIDDEN].T
        body *= 1 - hidden[:, :HIDDEN] ** 2
        dense["mix"] = read.reshape(-1, VALUE).T @ body
        d_read = (body @ p["mix"].T).reshape(read.shape)
        # a weight's share is weight / total; its slope is that of its value less the mean
        mean = (d_read * read).sum(axis=2, keepdims=True)
        d_weights = np.matmul(d_read, window[:, :, QUERY:-1].transpose(0, 2, 1))
        d_weights -= mean
        weights /= total
        d_weights *= weights
        d_value = np.matmul(weights.transpose(0, 2, 1), d_read)
        d_query = np.matmul(d_weights, window[:, :, :QUERY])
        d_key = np.matmul(d_weights.transpose(0, 2, 1), here[:, :, :QUERY])
        dense["near"] = np.bincount(NEAR.reshape(-1), d_weights.sum(axis=0).reshape(-1), SPAN).astype(np.float32)
        tables = {
            "here": _by_row(known[:, CONTEXT:], np.concatenate([d_query, body.reshape(*d_query.shape[:2], HIDDEN)], axis=2)),
            "window": _by_row(known, np.concatenate([d_key, d_value, np.zeros_like(d_key[:, :, :1])], axis=2)),
            "before": _by_row(known[:, CONTEXT - 1 : -1], body),
        }
        norm = np.sqrt(sum(float((x * x).sum()) for x in [*dense.values(), *(g for _, g in tables.values())]))
        down = np.float32(min(1.0, 1.0 / max(norm, 1e-9)))
        return {n: g * down for n, g in dense.items()}, {n: (rows, g * down) for n, (rows, g) in tables.items()}, hidden


def _by_row(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of ``values`` for each row that occurs."""
    rows, width = rows.reshape(-1), values.shape[-1]
    sums = np.zeros((ROWS + 1, width), values.dtype)
    cells = rows.astype(np.int64)[:, None] * width + np.arange(width)
    np.add.at(sums.reshape(-1), cells.reshape(-1), values.reshape(-1))  # quicker than sorting rows
    rows = np.nonzero(np.bincount(rows, minlength=ROWS + 1))[0]
    return rows, sums[rows]
