"""A small gated recurrent network with a class-factored softmax, in numpy."""

from __future__ import annotations

import heapq

import numpy as np

HIDDEN = 16
SAFE = 60.0  # logits within it need no shift before the exponential
WINDOW = 24  # steps of truncated back-propagation, and of a block of scoring


class Layout:
    """Words 0..V-1 in order of frequency, dealt to classes of about equal probability mass."""

    def __init__(self, counts: np.ndarray, classes: int):
        share = (counts + 1.0) / (counts + 1.0).sum()
        middle = np.cumsum(share) - share / 2
        self.word_class = np.unique(np.minimum((middle * classes).astype(int), classes - 1), return_inverse=True)[1].ravel()
        self.classes = int(self.word_class.max()) + 1
        self.start = np.searchsorted(self.word_class, np.arange(self.classes + 1))
        self.share = share
        self.shapes = {"emb": (len(counts), HIDDEN), "w": (HIDDEN, 3 * HIDDEN), "u": (HIDDEN, 3 * HIDDEN), "b": (3 * HIDDEN,), "c": (HIDDEN, self.classes), "cb": (self.classes,), "o": (len(counts), HIDDEN), "ob": (len(counts),)}

    def first(self, seed: int = 11) -> np.ndarray:
        """Parameters to begin with: the biases already give the words' frequencies."""
        rng = np.random.default_rng(seed)
        p = {k: rng.normal(0, 0.15, s) if len(s) == 2 else np.zeros(s) for k, s in self.shapes.items()}
        p["c"] *= 0.1
        p["o"] *= 0.1
        p["ob"] = np.log(self.share)
        p["cb"] = np.log(np.add.reduceat(self.share, self.start[:-1]))
        return np.concatenate([p[k].ravel() for k in self.shapes]).astype(np.float32)

    def named(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for k, s in self.shapes.items():
            n = int(np.prod(s))
            out[k] = flat[at : at + n].reshape(s)
            at += n
        return out

    def output(self, p: dict, h: np.ndarray, target: np.ndarray, grads: dict | None = None):
        """Natural log probability of each target word after state h; with ``grads`` also dloss/dh."""
        k = self.word_class[target]
        order = np.argsort(k, kind="stable")
        k, target, h = k[order], target[order], h[order]
        ends = np.searchsorted(k, np.arange(self.classes + 1))
        score, e = log_softmax(h @ p["c"] + p["cb"], k, grads is not None)
        if grads is not None:
            grads["c"] += h.T @ e
            grads["cb"] += e.sum(0)
            dh = e @ p["c"].T
        for c in range(self.classes):
            lo, hi = self.start[c], self.start[c + 1]
            if hi - lo == 1 or ends[c] == ends[c + 1]:
                continue
            own = slice(ends[c], ends[c + 1])
            part, e = log_softmax(h[own] @ p["o"][lo:hi].T + p["ob"][lo:hi], target[own] - lo, grads is not None)
            score[own] += part
            if grads is not None:
                grads["o"][lo:hi] += e.T @ h[own]
                grads["ob"][lo:hi] += e.sum(0)
                dh[own] += e @ p["o"][lo:hi]
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return (score[back], dh[back]) if grads is not None else score[back]


def log_softmax(logits: np.ndarray, target: np.ndarray, gradient: bool) -> tuple[np.ndarray, np.ndarray]:
    """(log probability of each row's target, gradient of the loss by the logits if wanted)."""
    row = np.arange(len(target))
    if max(logits.max(), -logits.min()) > SAFE:
        logits -= logits.max(1, keepdims=True)
    score = logits[row, target]
    e = np.exp(logits, out=logits)
    total = e @ np.ones(e.shape[1], e.dtype)
    score -= np.log(total)
    if gradient:
        e /= total[:, None]
        e[row, target] -= 1
    return score, e


def step(a: np.ndarray, hu: np.ndarray, h: np.ndarray, zr: np.ndarray, n: np.ndarray, new: np.ndarray) -> None:
    """One step of the gates from input a and hu = u' h (gates x lanes); fills zr, n and the new state."""
    H = len(h)
    np.add(a[: 2 * H], hu[: 2 * H], out=zr)
    zr *= 0.5
    np.tanh(zr, out=zr)
    zr *= 0.5
    zr += 0.5
    np.multiply(zr[H:], hu[2 * H :], out=n)
    n += a[2 * H :]
    np.tanh(n, out=n)
    np.subtract(h, n, out=new)
    new *= zr[:H]
    new += n


def input_table(p: dict) -> np.ndarray:
    """Gate inputs of every word (gates x words), and in the last column those of a text's begin."""
    out = np.empty((3 * HIDDEN, len(p["emb"]) + 1), p["emb"].dtype)
    np.matmul(p["w"].T, p["emb"].T, out=out[:, :-1])
    out[:, -1] = 0
    out += p["b"][:, None]
    return out


class Trainer:
    """Adam over whole texts (word numbers) by truncated back-propagation through time.

    Texts lie end to end on lanes of about equal length and are read in windows of WINDOW steps. The
    state of a text is carried into the next window, gradients are not; a text begins with the zero
    vector as input and state.
    """

    def __init__(self, layout: Layout, flat: np.ndarray, rate: float, seed: int, lanes: int = 256):
        self.layout, self.rate, self.lanes = layout, rate, lanes
        self.flat = flat.astype(np.float32).copy()
        self.m, self.v, self.step, self.words = np.zeros_like(self.flat), np.zeros_like(self.flat), 0, 0
        self.rng = np.random.default_rng(seed)

    def learn(self, texts: list[np.ndarray]) -> None:
        """One pass over all windows of the texts."""
        texts = [t for t in texts if len(t)]
        if not texts:
            return
        streams = Streams(dealt([texts[i] for i in self.rng.permutation(len(texts))], self.lanes))
        p, h = self.layout.named(self.flat), np.zeros((HIDDEN, streams.lanes), np.float32)
        self.full = min(WINDOW, streams.longest) * streams.lanes
        for at in range(0, streams.longest, WINDOW):
            before, ids = streams.window(at)
            grad = np.zeros_like(self.flat)
            h, n = window_gradient(self.layout, p, self.layout.named(grad), before, ids, h[:, : ids.shape[1]])
            self.words += n
            self._step(grad, n)

    def _step(self, grad: np.ndarray, n: int) -> None:
        grad /= n
        size = float(np.sqrt(grad @ grad))
        grad *= min(1.0, 1.0 / max(size, 1e-9))
        rate = self.rate * min(1.0, 4 * n / self.full)  # smaller steps where few lanes are left
        self.step += 1
        self.m += 0.1 * (grad - self.m)
        self.v += 0.01 * (grad * grad - self.v)
        self.flat -= rate * (self.m / (1 - 0.9**self.step)) / (np.sqrt(self.v / (1 - 0.99**self.step)) + 1e-6)


class Streams:
    """Lanes of texts end to end in one array: what is held is the words, whatever the lanes' lengths."""

    def __init__(self, lanes: list[list[np.ndarray]]):
        """lanes: the longest first."""
        texts = [t for lane in lanes for t in lane]
        self.words = np.concatenate(texts)
        self.begins = np.zeros(len(self.words), bool)
        self.begins[np.cumsum([0, *map(len, texts[:-1])])] = True
        self.sizes = np.array([sum(map(len, lane)) for lane in lanes])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.lanes, self.longest = len(lanes), int(self.sizes[0])

    def window(self, at: int) -> tuple[np.ndarray, np.ndarray]:
        """(words before, words) of the steps from ``at`` on (steps x lanes still running); -1 where there is none."""
        live = int(np.searchsorted(-self.sizes, -at))
        step = np.arange(at, min(at + WINDOW, self.longest))[:, None]
        inside = step < self.sizes[:live]
        place = np.where(inside, self.starts[:live] + step, 0)
        ids = np.where(inside, self.words[place].astype(np.int32), -1)
        before = np.where(inside & ~self.begins[place], self.words[place - 1].astype(np.int32), -1)
        return before, ids


def dealt(texts: list[np.ndarray], lanes: int) -> list[list[np.ndarray]]:
    """Texts put on at most ``lanes`` lanes, each to the shortest so far; the longest lane first."""
    out: list[list[np.ndarray]] = [[] for _ in range(min(lanes, len(texts)))]
    heap = [(0, j) for j in range(len(out))]
    for t in texts:
        n, j = heapq.heappop(heap)
        out[j].append(t)
        heapq.heappush(heap, (n + len(t), j))
    return sorted(out, key=lambda lane: -sum(map(len, lane)))


def window_gradient(layout: Layout, p: dict, g: dict, before: np.ndarray, ids: np.ndarray, h: np.ndarray):
    """Adds the window's gradients to g; (state after the window (units x lanes), words scored).

    Where ``before`` is negative a text begins: its input and state are zero.
    """
    H, (steps, lanes), kind = HIDDEN, ids.shape, p["u"].dtype
    begin = before < 0
    begins = begin.any(1)
    table, index, turned = input_table(p), np.where(begin, len(p["emb"]), before), np.ascontiguousarray(p["u"].T)
    states, zr = np.empty((steps, H, lanes), kind), np.empty((steps, 2 * H, lanes), kind)
    n, hn, olds = np.empty((steps, H, lanes), kind), np.empty((steps, H, lanes), kind), []
    for t in range(steps):
        if begins[t]:
            h = h.copy()
            h[:, begin[t]] = 0
        olds.append(h)
        hu = turned @ h
        hn[t] = hu[2 * H :]
        step(np.take(table, index[t], axis=1), hu, h, zr[t], n[t], states[t])
        h = states[t]
    real = ids >= 0
    count = int(real.sum())
    if not count:
        return h, 0
    _, dh_real = layout.output(p, states.transpose(0, 2, 1)[real], ids[real], g)
    dout = np.zeros((steps, lanes, H), kind)
    dout[real] = dh_real
    dout = np.ascontiguousarray(dout.transpose(0, 2, 1))
    dh, da = np.zeros((H, lanes), kind), np.empty((steps, 3 * H, lanes), kind)
    du = np.empty((3 * H, lanes), kind)
    for t in reversed(range(steps)):
        z, r, old, d = zr[t, :H], zr[t, H:], olds[t], da[t]
        dh += dout[t]
        scaled = 1 - z
        scaled *= dh
        np.subtract(old, n[t], out=d[:H])
        d[:H] *= scaled
        d[:H] *= z
        dn = d[2 * H :]
        np.multiply(n[t], n[t], out=dn)
        np.subtract(1, dn, out=dn)
        dn *= scaled
        np.multiply(dn, r, out=du[2 * H :])
        np.subtract(1, r, out=d[H : 2 * H])
        d[H : 2 * H] *= du[2 * H :]
        d[H : 2 * H] *= hn[t]
        du[: 2 * H] = d[: 2 * H]
        g["u"] += old @ du.T
        dh *= z
        dh += p["u"] @ du
        if begins[t]:
            dh[:, begin[t]] = 0
    g["b"] += da.sum((0, 2))
    live = np.flatnonzero(~begin)
    if len(live):
        word = before.ravel()[live]
        order = np.argsort(word, kind="stable")
        first = np.flatnonzero(np.diff(word[order], prepend=-1))
        names = word[order[first]]
        each = np.add.reduceat(da.transpose(0, 2, 1).reshape(-1, 3 * H)[live[order]], first)
        g["emb"][names] += each @ p["w"].T
        g["w"] += p["emb"][names].T @ each
    return h, count


class Scorer:
    """Log10 probabilities of whole texts; the state runs through all windows of a text."""

    def __init__(self, layout: Layout, flat: np.ndarray, lanes: int = 512):
        self.layout, self.p, self.lanes = layout, layout.named(flat.astype(np.float32)), lanes
        self.table, self.turned = input_table(self.p), np.ascontiguousarray(self.p["u"].T)

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """texts: word numbers. Texts are put end to end on lanes of about equal length."""
        total = np.zeros(len(texts))
        if not texts:
            return total
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        lanes: list[list[int]] = [[] for _ in range(min(self.lanes, len(texts)))]
        heap = [(0, j) for j in range(len(lanes))]
        for i in order:
            n, j = heapq.heappop(heap)
            lanes[j].append(i)
            heapq.heappush(heap, (n + len(texts[i]), j))
        streams = [np.concatenate([texts[i] for i in lane]) for lane in lanes]
        owners = [np.repeat(np.array(lane, np.int32), [len(texts[i]) for i in lane]) for lane in lanes]
        by = sorted(range(len(lanes)), key=lambda j: -len(streams[j]))
        streams, owners = [streams[j] for j in by], [owners[j] for j in by]
        sizes = np.array([len(s) for s in streams])
        H, none = HIDDEN, self.table.shape[1] - 1
        h = np.zeros((H, len(streams)), np.float32)
        last = np.full(len(streams), -1)
        for at in range(0, int(sizes[0]), WINDOW):
            live = int(np.searchsorted(-sizes, -at))
            h = np.ascontiguousarray(h[:, :live])
            width = min(WINDOW, int(sizes[0]) - at)
            ids, own = np.full((width, live), -1), np.full((width, live), -1)
            for j in range(live):
                part = streams[j][at : at + width]
                ids[: len(part), j] = part
                own[: len(part), j] = owners[j][at : at + width]
            before_id = np.vstack([np.where(at > 0, self.held[:live], -1)[None], ids[:-1]]) if at else np.vstack([np.full((1, live), -1), ids[:-1]])
            before_own = np.vstack([last[:live][None], own[:-1]])
            fresh = before_own != own
            inputs = np.where(fresh, none, before_id)
            states, zr, n = np.empty((width, H, live), np.float32), np.empty((2 * H, live), np.float32), np.empty((H, live), np.float32)
            begins = fresh.any(1)
            for t in range(width):
                if begins[t]:
                    h = h.copy()
                    h[:, fresh[t]] = 0
                step(np.take(self.table, inputs[t], axis=1), self.turned @ h, h, zr, n, states[t])
                h = states[t]
            real = own >= 0
            got = self.layout.output(self.p, states.transpose(0, 2, 1)[real], ids[real])
            total += np.bincount(own[real], got, len(texts))
            last, self.held = own[-1], ids[-1]
        return total / np.log(10)
