"""Small recurrent networks in numpy: LSTM and GRU layers with their gradients, a linear-chain CRF, and Adam.

Arrays are time first: (steps, batch, features).
"""

from __future__ import annotations

import numpy as np

F32 = np.float32


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def glorot(rng: np.random.Generator, rows: int, cols: int) -> np.ndarray:
    return rng.uniform(-1, 1, (rows, cols)).astype(F32) * F32(np.sqrt(6 / (rows + cols)))


class Adam:
    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.params, self.rate, self.step = params, rate, 0
        self.mean = {k: np.zeros_like(v) for k, v in params.items()}
        self.square = {k: np.zeros_like(v) for k, v in params.items()}

    def update(self, grads: dict[str, np.ndarray], limit: float = 5.0) -> None:
        self.step += 1
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        scale = F32(min(1.0, limit / (norm + 1e-9)))
        rate = self.rate * np.sqrt(1 - 0.999**self.step) / (1 - 0.9**self.step)
        for k, g in grads.items():
            g = g * scale
            self.mean[k] = F32(0.9) * self.mean[k] + F32(0.1) * g
            self.square[k] = F32(0.999) * self.square[k] + F32(0.001) * g * g
            self.params[k] -= F32(rate) * self.mean[k] / (np.sqrt(self.square[k]) + F32(1e-8))


#: Slope of the LSTM's gates, which are straight lines cut off at 0 and 1.
GATE = F32(0.25)


def softsign(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


def lstm_forward(z: np.ndarray, u: np.ndarray, keep: bool = False):
    """States of an LSTM whose inputs are already projected: z is (steps, batch, 4 h) in the order i, f, o, g.

    Gates are hard sigmoids, and softsign stands where tanh would: both cost a few passes over memory.
    """
    steps, batch, width = z.shape
    h = width // 4
    state, cell = np.zeros((batch, h), F32), np.zeros((batch, h), F32)
    states = np.empty((steps, batch, h), F32)
    kept = []
    for t in range(steps):
        a = z[t] + state @ u
        gates = np.clip(GATE * a[:, : 3 * h] + F32(0.5), 0, 1)
        fresh = softsign(a[:, 3 * h :])
        before = cell
        cell = gates[:, h : 2 * h] * cell + gates[:, :h] * fresh
        squashed = softsign(cell)
        if keep:
            kept.append((state, before, gates, fresh, squashed))
        state = gates[:, 2 * h :] * squashed
        states[t] = state
    return (states, kept) if keep else states


def stacked(w: np.ndarray, u: np.ndarray, b: np.ndarray) -> np.ndarray:
    """An LSTM's weights as one matrix over (state, input, 1), for ``lstm_scores``; the gates' line is part of it."""
    h = u.shape[0]
    scale = np.repeat(np.array([GATE, 1], F32), [3 * h, h])
    whole = np.concatenate([u, w, b[None]]) * scale
    whole[-1, : 3 * h] += F32(0.5)
    return np.ascontiguousarray(whole.T)


def lstm_scores(
    inputs: np.ndarray, active: list[int], weights: np.ndarray, out: np.ndarray, scores: np.ndarray, back: bool = False
) -> None:
    """An LSTM's states times ``out`` at every step of embedded sequences (features, steps, sequences), without gradients.

    They are written into ``scores`` (steps, columns of ``out``, sequences); read from the ends (``back``), they are added
    to what is there.  Sequences are sorted from the longest down: the first ``active[t]`` have a step t.  Features come
    first in all work arrays, so each gate is one block of memory.  Columns are taken in and left out an eighth at a
    time; those of no sequence hold what nobody reads.
    """
    e, steps, count = inputs.shape
    h, tags = out.shape
    out = np.ascontiguousarray(out.T)
    work, spare, part = np.empty(4 * h * count, F32), np.empty(h * count, F32), np.empty(tags * count, F32)
    # Of the arrays' own type and shape: numpy converts nothing, and its minima and maxima of arrays are faster than a clip.
    one, zeros, ones = np.ones((), F32), np.zeros(h * count, F32), np.ones(h * count, F32)
    width, begun, state, cell = 0, 0, np.empty((h, 0), F32), np.empty((h, 0), F32)
    for t in range(steps - 1, -1, -1) if back else range(steps):
        k = active[t]
        if k > width or (not back and k <= width - width // 8 - 1):
            width = min(count, k + k // 8) if back else k
            kept = min(width, cell.shape[1])
            into, cells = np.zeros((h + e + 1, width), F32), np.zeros((h, width), F32)
            into[:h, :kept], into[-1], cells[:, :kept] = state[:, :kept], 1, cell[:, :kept]
            cell, state, taken = cells, into[:h], into[h : h + e]
            a, fresh = work[: 4 * h * width].reshape(-1, width), spare[: h * width].reshape(h, width)
            gates, new, low, high = a[: 3 * h].reshape(3, -1), a[3 * h :], zeros[: h * width], ones[: h * width]
            added = part[: tags * width].reshape(tags, width)
            enter, keep, leave = a[:h], a[h : 2 * h], a[2 * h : 3 * h]
        if back and k > begun:
            # A sequence begins without a state, whatever its column held before.
            state[:, begun:k] = cell[:, begun:k] = 0
            begun = k
        np.copyto(taken, inputs[:, t, :width])
        np.matmul(weights, into, out=a)
        np.maximum(gates, low, out=gates)
        np.minimum(gates, high, out=gates)
        np.abs(new, out=fresh)
        np.add(fresh, one, out=fresh)
        np.divide(new, fresh, out=new)
        np.multiply(new, enter, out=new)
        np.multiply(cell, keep, out=cell)
        np.add(cell, new, out=cell)
        np.abs(cell, out=fresh)
        np.add(fresh, one, out=fresh)
        np.divide(cell, fresh, out=fresh)
        np.multiply(leave, fresh, out=state)
        own = scores[t, :, :width]
        if back:
            np.matmul(out, state, out=added)
            np.add(own, added, out=own)
        else:
            np.matmul(out, state, out=own)


def lstm_backward(d_states: np.ndarray, u: np.ndarray, kept: list) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the projected inputs and of ``u``."""
    steps, batch, h = d_states.shape
    dz = np.empty((steps, batch, 4 * h), F32)
    du = np.zeros_like(u)
    d_state, d_cell = np.zeros((batch, h), F32), np.zeros((batch, h), F32)
    for t in range(steps - 1, -1, -1):
        state, before, gates, fresh, squashed = kept[t]
        i, f, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
        slope = GATE * ((gates > 0) & (gates < 1))
        d_out = d_states[t] + d_state
        # softsign's derivative is (1 - |its value|) squared.
        d_cell = d_cell + d_out * o * (1 - np.abs(squashed)) ** 2
        a = dz[t]
        a[:, :h] = d_cell * fresh * slope[:, :h]
        a[:, h : 2 * h] = d_cell * before * slope[:, h : 2 * h]
        a[:, 2 * h : 3 * h] = d_out * squashed * slope[:, 2 * h :]
        a[:, 3 * h :] = d_cell * i * (1 - np.abs(fresh)) ** 2
        du += state.T @ a
        d_state = a @ u.T
        d_cell = d_cell * f
    return dz, du


def gru_forward(z: np.ndarray, u: np.ndarray, keep: bool = False):
    """States of a GRU whose inputs are already projected: z is (steps, batch, 3 h) in the order reset, update, new.

    The reset gate scales the recurrent part of the new state.
    """
    steps, batch, width = z.shape
    h = width // 3
    state = np.zeros((batch, h), F32)
    states = np.empty((steps, batch, h), F32)
    kept = []
    for t in range(steps):
        a = state @ u
        gates = sigmoid(z[t, :, : 2 * h] + a[:, : 2 * h])
        reset, update = gates[:, :h], gates[:, h:]
        fresh = np.tanh(z[t, :, 2 * h :] + reset * a[:, 2 * h :])
        if keep:
            kept.append((state, a[:, 2 * h :], reset, update, fresh))
        state = fresh + update * (state - fresh)
        states[t] = state
    return (states, kept) if keep else states


def gru_backward(d_states: np.ndarray, u: np.ndarray, kept: list) -> tuple[np.ndarray, np.ndarray]:
    steps, batch, h = d_states.shape
    dz = np.empty((steps, batch, 3 * h), F32)
    du = np.zeros_like(u)
    d_state = np.zeros((batch, h), F32)
    for t in range(steps - 1, -1, -1):
        state, recurrent, reset, update, fresh = kept[t]
        d_out = d_states[t] + d_state
        d_fresh = d_out * (1 - update) * (1 - fresh * fresh)
        a = np.empty((batch, 3 * h), F32)
        a[:, :h] = d_fresh * recurrent * reset * (1 - reset)
        a[:, h : 2 * h] = d_out * (state - fresh) * update * (1 - update)
        a[:, 2 * h :] = d_fresh
        dz[t] = a
        a[:, 2 * h :] *= reset
        du += state.T @ a
        d_state = d_out * update + a @ u.T
    return dz, du


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def crf_gradient(emit: np.ndarray, trans: np.ndarray, tags: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log likelihood of ``tags`` (steps, batch), and the gradients of emissions and transitions."""
    steps, batch, n = emit.shape
    forward = np.empty_like(emit)
    forward[0] = emit[0]
    for t in range(1, steps):
        forward[t] = _logsumexp(forward[t - 1][:, :, None] + trans, 1) + emit[t]
    total = _logsumexp(forward[-1], 1)
    back = np.zeros((batch, n), F32)
    d_emit = np.empty_like(emit)
    d_trans = np.zeros_like(trans)
    d_emit[-1] = np.exp(forward[-1] - total[:, None])
    for t in range(steps - 1, 0, -1):
        ahead = emit[t] + back
        d_trans += np.exp(forward[t - 1][:, :, None] + trans + ahead[:, None, :] - total[:, None, None]).sum(0)
        back = _logsumexp(trans + ahead[:, None, :], 2)
        d_emit[t - 1] = np.exp(forward[t - 1] + back - total[:, None])
    at = np.arange(steps)[:, None], np.arange(batch), tags
    score = emit[at].sum(0) + trans[tags[:-1], tags[1:]].sum(0)
    d_emit[at] -= 1
    np.add.at(d_trans, (tags[:-1], tags[1:]), -1)
    return float((total - score).mean()), d_emit / batch, d_trans / batch


def viterbi(emit: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best tags (steps, batch), and how far each step's best tag is ahead of the best other one by max-marginals."""
    steps, batch, n = emit.shape
    score = np.empty_like(emit)
    back = np.empty((steps, batch, n), np.int8)
    score[0] = emit[0]
    for t in range(1, steps):
        ways = score[t - 1][:, :, None] + trans
        back[t] = ways.argmax(1)
        score[t] = np.take_along_axis(ways, back[t][:, None, :].astype(np.int64), 1)[:, 0] + emit[t]
    tags = np.empty((steps, batch), np.int64)
    margin = np.empty((steps, batch), F32)
    ahead = np.zeros((batch, n), F32)
    tags[-1] = score[-1].argmax(1)
    rows = np.arange(batch)
    for t in range(steps - 1, -1, -1):
        whole = score[t] + ahead
        if t < steps - 1:
            tags[t] = back[t + 1][rows, tags[t + 1]]
        best = whole[rows, tags[t]].copy()
        whole[rows, tags[t]] = -np.inf
        margin[t] = best - whole.max(1)
        ahead = (trans + (emit[t] + ahead)[:, None, :]).max(2)
    return tags, margin


def best_tags(emit: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``viterbi``, for emissions (steps, tags, batch): best tags by max-marginals, and their margins.

    Where the best path has tag 0 throughout, the margins are left at 0.
    """
    steps, n, batch = emit.shape
    score = np.empty_like(emit)
    ways = np.empty((n, n, batch), F32)
    into, out = trans.T[:, :, None].astype(F32), trans[:, :, None].astype(F32)
    score[0] = emit[0]
    none = emit[0, 0].copy()
    for t in range(1, steps):
        np.add(score[t - 1], into, out=ways)
        np.max(ways, axis=1, out=score[t])
        score[t] += emit[t]
        # In the same order as above, so the path of tag 0 alone has exactly this score.
        none += into[0, 0]
        none += emit[t, 0]
    tags, margin = np.zeros((steps, batch), np.int8), np.zeros((steps, batch), F32)
    some = np.flatnonzero(score[-1].max(0) > none)
    if not len(some):
        return tags, margin
    score, emit = np.ascontiguousarray(score[:, :, some]), np.ascontiguousarray(emit[:, :, some])
    ways = np.empty((n, n, len(some)), F32)
    ahead = np.zeros((n, len(some)), F32)
    for t in range(steps - 1, -1, -1):
        score[t] += ahead
        np.add(emit[t] + ahead, out, out=ways)
        np.max(ways, axis=1, out=ahead)
    best, own = score.max(1), score.argmax(1)
    np.put_along_axis(score, own[:, None], -np.inf, 1)
    tags[:, some], margin[:, some] = own, best - score.max(1)
    return tags, margin
