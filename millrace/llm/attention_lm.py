"""A small causal self-attention model over subword ids, in numpy: blocks, forward pass, gradients, training.

A text is cut into blocks of BLOCK tokens; each block attends, under a causal mask, to itself and the block before it,
so context windows of 2 * BLOCK tokens overlap by half and each token is scored once, with BLOCK tokens of context or
more (fewer only at the start of its text). Next ids are drawn in two steps, class then member; the logits of both are
those of the attention network added to a prior, log counts of the whole corpus: one for all places, or one for each last id.
"""

from __future__ import annotations

import numpy as np

#: Tokens in a block, width (of the one head), hidden units, classes and members of each: CLASSES * MEMBERS ids in all.
BLOCK, WIDTH, HIDDEN, CLASSES, MEMBERS = 16, 16, 32, 32, 32
IDS = CLASSES * MEMBERS
F32 = np.float32
#: Rows of blocks that are trained on together, steps after which a step takes one such run more, and the most runs of a step.
RUN, MORE, MOST_RUNS = 16, 150, 16
#: Runs whose gradients are made at once: their arrays stay in a core's cache.
AT_ONCE = 8
#: No logit is above this, so that exponentials add up in single precision.
MOST = F32(60)


def fresh(seed: int = 11) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    shape = {"embed": (IDS, WIDTH), "q": (WIDTH, WIDTH), "k": (WIDTH, WIDTH), "v": (WIDTH, WIDTH), "o": (WIDTH, WIDTH), "up": (WIDTH, HIDDEN), "down": (HIDDEN, WIDTH)}
    p = {n: (rng.standard_normal(s) * (0.3 if n == "embed" else s[0] ** -0.5)).astype(F32) for n, s in shape.items()}
    p |= {"far": np.zeros((1, 2 * BLOCK), F32), "up_b": np.zeros(HIDDEN, F32), "cls": np.zeros((WIDTH, CLASSES), F32), "cls_b": np.zeros(CLASSES, F32), "mem": np.zeros((IDS, WIDTH), F32), "mem_b": np.zeros(IDS, F32)}
    return p


def blocks(texts: list[np.ndarray], end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Inputs and targets as rows of BLOCK ids, whether a row continues the one before it, and each row's text.

    A text reads end, ids and predicts ids, end; places beyond it have target -1.
    """
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    rows = -(-sizes // BLOCK)
    first = np.concatenate([[0], np.cumsum(rows)])
    ids, goal = np.full(first[-1] * BLOCK, end, np.int64), np.full(first[-1] * BLOCK, -1, np.int64)
    if texts:
        flat = np.concatenate(texts).astype(np.int64)
        starts = first[:-1] * BLOCK
        inner = np.arange(len(flat)) - np.repeat(np.cumsum(sizes - 1) - (sizes - 1), sizes - 1)
        at = np.repeat(starts, sizes - 1) + inner
        goal[at] = flat
        goal[starts + sizes - 1] = end
        ids[at + 1] = flat
    continues = np.ones(first[-1], bool)
    continues[first[:-1]] = False
    return ids.reshape(-1, BLOCK), goal.reshape(-1, BLOCK), continues, np.repeat(np.arange(len(texts)), rows)


_AGO = np.arange(BLOCK)[:, None] + BLOCK - np.arange(2 * BLOCK)[None, :]  # how far back each key lies
_OPEN = _AGO >= 0
_DISTANCE = np.clip(_AGO, 0, 2 * BLOCK - 1)


def _with_last(x: np.ndarray, continues: np.ndarray) -> np.ndarray:
    """Each row's block after that of the row before it, zeros where it starts a text."""
    out = np.empty((len(x), 2 * BLOCK, x.shape[2]), x.dtype)
    out[:, BLOCK:] = x
    out[1:, :BLOCK] = x[:-1]
    out[~continues, :BLOCK] = 0
    return out


def _times(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """x @ w as one product of two matrices, not one a block."""
    return (x.reshape(-1, x.shape[-1]) @ w).reshape(*x.shape[:-1], w.shape[1])


def _folded(p: dict) -> tuple[np.ndarray, np.ndarray]:
    """With one head, queries times keys and values times the output are products of the inputs with one matrix each."""
    return p["q"] @ p["k"].T * F32(WIDTH**-0.5), p["v"] @ p["o"]


def forward(p: dict, ids: np.ndarray, continues: np.ndarray) -> tuple[np.ndarray, tuple]:
    qk, vo = _folded(p)
    x = p["embed"].take(ids, axis=0)
    y, xx = _times(x, qk), _with_last(x, continues)
    s = y @ xx.transpose(0, 2, 1)
    s += np.where(_OPEN, p["far"][0][_DISTANCE], F32(-1e9))
    s[~continues, :, :BLOCK] = -1e9
    a = np.exp(np.minimum(s, MOST, out=s), out=s)  # no row is closed: each key sees itself
    a /= (a @ np.ones(2 * BLOCK, F32))[..., None]
    o = a @ xx
    h1 = _times(o, vo)
    h1 += x
    u = _times(h1, p["up"])
    u += p["up_b"]
    np.maximum(u, 0, out=u)
    h = _times(u, p["down"])
    h += h1
    return h, (x, y, xx, a, o, h1, u)


def by_class(goal: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, slice]]]:
    """Order of flat targets by class, the class of each in that order, and each class that occurs with its places there."""
    cls = (goal // MEMBERS).astype(np.int16)
    order = np.argsort(cls, kind="stable")
    cls = cls[order]
    cuts = np.searchsorted(cls, np.arange(CLASSES + 1)).tolist()
    return order, cls, [(c, slice(cuts[c], cuts[c + 1])) for c in range(CLASSES) if cuts[c + 1] > cuts[c]]


def _class_logits(p: dict, prior: dict, h: np.ndarray, last: np.ndarray) -> np.ndarray:
    z = h @ p["cls"]
    z += p["cls_b"] + (prior["cls"] if prior["cls"].ndim == 1 else prior["cls"].take(last, axis=0))
    return _bounded(z)


def _member_logits(p: dict, prior: dict, h: np.ndarray, last: np.ndarray, cls: np.ndarray, groups: list[tuple[int, slice]]) -> np.ndarray:
    """Logits of the members of each target's class; rows are sorted by class."""
    z = np.empty((len(h), MEMBERS), h.dtype)
    weights = p["mem"].reshape(CLASSES, MEMBERS, WIDTH).transpose(0, 2, 1)
    always = (p["mem_b"] + prior["mem"] if prior["mem"].ndim == 1 else p["mem_b"]).reshape(CLASSES, MEMBERS)
    for c, i in groups:
        np.matmul(h[i], weights[c], out=z[i])
        z[i] += always[c]
    if prior["mem"].ndim > 1:
        z += prior["mem"].reshape(-1, MEMBERS).take(last * CLASSES + cls, axis=0)
    return _bounded(z)


def _bounded(z: np.ndarray) -> np.ndarray:
    return np.minimum(z, MOST, out=z)


def _normalisers(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log of the sum of each row's exponentials, and these in z's place; logits are bounded, so nothing overflows."""
    total = np.exp(z, out=z) @ np.ones(z.shape[1], F32)
    return np.log(total), total


def log_probs(p: dict, prior: dict, ids: np.ndarray, goal: np.ndarray, continues: np.ndarray) -> np.ndarray:
    """Natural log of the probability of each target, 0 where there is none."""
    h, _ = forward(p, ids, continues)
    at = np.flatnonzero(goal.ravel() >= 0)
    h, last, want = h.reshape(-1, WIDTH)[at], ids.ravel()[at], goal.ravel()[at]
    order, cls, groups = by_class(want)
    h, last, want = h[order], last[order], want[order]
    rows = np.arange(len(at))
    z = _class_logits(p, prior, h, last)
    own = z[rows, cls]
    found = own - _normalisers(z)[0]
    z = _member_logits(p, prior, h, last, cls, groups)
    own = z[rows, want % MEMBERS]
    found += own - _normalisers(z)[0]
    out = np.zeros(goal.size)
    out[at[order]] = found
    return out.reshape(goal.shape)


def gradients(p: dict, prior: dict, ids: np.ndarray, goal: np.ndarray, continues: np.ndarray) -> tuple[dict, float]:
    """Gradients of the mean loss over the targets, and that loss."""
    h, (x, y, xx, a, o, h1, u) = forward(p, ids, continues)
    at = np.flatnonzero(goal.ravel() >= 0)
    order, cls, groups = by_class(goal.ravel()[at])
    at = at[order]
    hv, last, want = h.reshape(-1, WIDTH)[at], ids.ravel()[at], goal.ravel()[at]
    n, rows = len(at), np.arange(len(at))
    g: dict = {"mem": np.zeros_like(p["mem"]), "mem_b": np.zeros_like(p["mem_b"])}
    prob = _class_logits(p, prior, hv, last)
    own = prob[rows, cls].copy()
    norm, total = _normalisers(prob)
    prob /= total[:, None] * F32(n)
    loss = (norm - own).sum()
    prob[rows, cls] -= F32(1 / n)
    g["cls"], g["cls_b"], dh = hv.T @ prob, _sums(prob), prob @ p["cls"].T
    prob = _member_logits(p, prior, hv, last, cls, groups)
    own = prob[rows, want % MEMBERS].copy()
    norm, total = _normalisers(prob)
    prob /= total[:, None] * F32(n)
    loss += (norm - own).sum()
    prob[rows, want % MEMBERS] -= F32(1 / n)
    for c, i in groups:
        span = slice(c * MEMBERS, (c + 1) * MEMBERS)
        np.matmul(prob[i].T, hv[i], out=g["mem"][span])
        g["mem_b"][span] = _sums(prob[i])
        dh[i] += prob[i] @ p["mem"][span]
    d = np.zeros((goal.size, WIDTH), F32)
    d[at] = dh
    d = d.reshape(h.shape)
    flat = lambda y: y.reshape(-1, y.shape[-1])
    g["down"] = flat(u).T @ flat(d)
    du = _times(d, p["down"].T)
    du *= u > 0
    g["up"], g["up_b"] = flat(h1).T @ flat(du), _sums(flat(du))
    d1 = _times(du, p["up"].T)
    d1 += d
    qk, vo = _folded(p)
    dvo = flat(o).T @ flat(d1)
    do = _times(d1, vo.T)
    da = do @ xx.transpose(0, 2, 1)
    da -= np.einsum("rqk,rqk->rq", da, a)[..., None]
    ds = np.multiply(da, a, out=da)
    by_place = _sums(ds.reshape(len(ds), -1))
    g["far"] = np.bincount(_DISTANCE.ravel(), np.where(_OPEN.ravel(), by_place, 0), minlength=2 * BLOCK).astype(F32)[None]
    dy = ds @ xx
    dxx = np.concatenate([a, ds], axis=1).transpose(0, 2, 1) @ np.concatenate([do, y], axis=1)
    dqk = flat(x).T @ flat(dy) * F32(WIDTH**-0.5)
    g["q"], g["k"], g["v"], g["o"] = dqk @ p["k"], dqk.T @ p["q"], dvo @ p["o"].T, p["v"].T @ dvo
    dx = _times(dy, qk.T)
    dx += d1
    dx += dxx[:, BLOCK:]
    dx[:-1] += dxx[1:, :BLOCK] * continues[1:, None, None]
    g["embed"] = np.stack([np.bincount(ids.ravel(), y, minlength=IDS) for y in flat(dx).T], axis=1).astype(F32)
    return g, float(loss / max(n, 1))


def _sums(x: np.ndarray) -> np.ndarray:
    """Sums of the columns, as a product."""
    return np.ones(len(x), x.dtype) @ x


def unpacked(flat: np.ndarray) -> dict[str, np.ndarray]:
    """The weights by name, as views of one vector."""
    out, at = {}, 0
    for name, w in fresh().items():
        out[name] = flat[at : at + w.size].reshape(w.shape)
        at += w.size
    return out


def begin() -> np.ndarray:
    """The state that training starts from: rows of weights, mean gradients and mean squares."""
    w = np.concatenate([x.ravel() for x in fresh().values()])
    return np.stack([w, np.zeros_like(w), np.zeros_like(w)])


def train(texts: list[np.ndarray], prior: dict, end: int, state: np.ndarray, steps: float = 0.0, span: tuple[float, float] = (0.0, 1.0), rate: float = 2e-2, seed: int = 5) -> tuple[np.ndarray, float, float]:
    """One pass of Adam over rows of blocks, runs of RUN rows in random order; gives state, steps and mean loss.

    A step takes one run at first and one more after every MORE steps, MOST_RUNS at most.

    steps were made before; span is the part of all training that this pass stands for: over the whole the rate falls to a tenth.
    """
    state = state.copy()
    w, m, s = state
    p = unpacked(w)
    ids, goal, continues, _ = blocks(texts, end)
    runs = np.random.default_rng(seed).permutation(-(-len(ids) // RUN))
    continues[::RUN] = False
    loss, done = 0.0, 0
    while done < len(runs):
        take = runs[done : done + min(MOST_RUNS, 1 + int(steps) // MORE)]
        done += len(take)
        g, mean, n = np.zeros_like(w), 0.0, 0
        for few in np.split(take, range(AT_ONCE, len(take), AT_ONCE)):
            at = (few[:, None] * RUN + np.arange(RUN)).ravel()
            at = at[at < len(ids)]
            found, own = gradients(p, prior, ids[at], goal[at], continues[at])
            k = int((goal[at] >= 0).sum())
            g += np.concatenate([found[x].ravel() for x in p]) * F32(k)
            mean, n = mean + own * k, n + k
        g /= F32(max(n, 1))
        loss += mean / max(n, 1) * len(take) / len(runs)
        steps += 1
        now = rate * min(1.0, steps / 30) * (1 - 0.9 * (span[0] + (span[1] - span[0]) * done / len(runs)))
        m *= F32(0.9)
        m += F32(0.1) * g
        s *= F32(0.98)
        g *= g
        s += F32(0.02) * g
        np.sqrt(s * F32(1 / (1 - 0.98**steps)), out=g)
        g += F32(1e-8)
        np.divide(m, g, out=g)
        w -= F32(now / (1 - 0.9**steps)) * g
    return state, steps, loss
