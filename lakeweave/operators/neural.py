"""Small models in NumPy on thinned samples: transport, kernel matching, propagation, adversarial and test-time adaptation.

Every function takes arrays that the caller has bounded (``adapt.sampled``, or the blocks of ``nets``, which fits to all
rows), and returns probabilities or a model whose ``predict`` runs on batches, so predictions over all rows stay distributed.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def kernel_gamma(source: np.ndarray) -> float:
    """One over the median squared distance of the first 500 rows."""
    near = squared_distances(source[:500], source[:500])
    np.fill_diagonal(near, 0)  # else rounding makes some of them count
    return float(1 / max(1e-9, np.median(near[near > 0]) if (near > 0).any() else 1.0))


def kernel_sums(source: np.ndarray, target: np.ndarray, gamma: float, block: int = 500) -> np.ndarray:
    """Of each source row, the sum of the kernel over target rows, taken in blocks."""
    out = np.zeros(len(source))
    for i in range(0, len(target), block):
        out += np.exp(-gamma * squared_distances(target[i : i + block], source)).sum(0)
    return out


def kernel_mean_fit(source: np.ndarray, gamma: float, kappa: np.ndarray, most: float = 10.0, slack: float = 0.1, steps: int = 300) -> np.ndarray:
    """Row weights in [0, ``most``] for ``kappa``: the mean kernel over the target times the number of source rows."""
    k = squared_distances(source, source)
    k *= -gamma
    np.exp(k, out=k)
    w = np.ones(len(source))
    rate = 1 / max(1e-9, k.sum(0).max())
    for _ in range(steps):
        w = np.clip(w - rate * (k @ w - kappa), 0, most)
        mean = w.mean()
        if abs(mean - 1) > slack and mean > 0:
            w = np.clip(w * ((1 + slack * np.sign(mean - 1)) / mean), 0, most)
    return w


def kernel_mean_weights(source: np.ndarray, target: np.ndarray, most: float = 10.0, slack: float = 0.1, steps: int = 300) -> np.ndarray:
    """Row weights in [0, ``most``] that bring the source's kernel mean to the target's, by projected gradient descent.

    The kernel is Gaussian with the median distance as its width; the mean weight stays within ``slack`` of 1.
    """
    gamma = kernel_gamma(source)
    return kernel_mean_fit(source, gamma, kernel_sums(source, target, gamma) * len(source) / len(target), most, slack, steps)


def transported(source: np.ndarray, label: np.ndarray, target: np.ndarray, guess: np.ndarray, strength: float = 0.1, steps: int = 200) -> np.ndarray:
    """Source rows moved to the target, class by class: entropic optimal transport in log space, then barycentres.

    ``guess`` holds the target's pseudo-labels; a class that the target lacks stays where it is.
    """
    out = source.astype(float).copy()
    for c in np.unique(label):
        a, b = np.flatnonzero(label == c), np.flatnonzero(guess == c)
        if not len(a) or not len(b):
            continue
        cost = np.maximum((source[a] ** 2).sum(1)[:, None] + (target[b] ** 2).sum(1)[None] - 2 * source[a] @ target[b].T, 0)
        k = -cost / (strength * max(1e-9, np.median(cost)))
        f, g = np.zeros(len(a)), np.zeros(len(b))
        lse = lambda x, axis: x.max(axis) + np.log(np.exp(x - x.max(axis, keepdims=True)).sum(axis))
        for _ in range(steps):
            f = -np.log(len(a)) - lse(k + g[None], 1)
            g = -np.log(len(b)) - lse(k + f[:, None], 0)
        plan = np.exp(k + f[:, None] + g[None])
        out[a] = plan @ target[b] / np.maximum(plan.sum(1, keepdims=True), 1e-300)
    return out


def soft_plan(source: np.ndarray, target: np.ndarray, g: np.ndarray, scale: float) -> np.ndarray:
    """Rows of the entropic plan for the target's potentials ``g``, each divided by its sum (source potentials cancel)."""
    k = squared_distances(source, target)
    k /= -scale
    k += g[None]
    k -= k.max(1, keepdims=True)
    np.exp(k, out=k)
    k /= k.sum(1, keepdims=True)
    return k


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All pairs, in one array that is changed in place."""
    d = (-2 * a) @ b.T
    d += (a**2).sum(1)[:, None]
    d += (b**2).sum(1)[None]
    return np.maximum(d, 0, out=d)


def spread(x: np.ndarray, label: np.ndarray, gamma: float = 0.25, keep: float = 0.8, steps: int = 200) -> np.ndarray:
    """Class probabilities (n, 2) of each row from the labelled ones (-1: unlabelled) by spreading over a Gaussian
    similarity graph; zeros for a row that no label reaches."""
    s = np.exp(-gamma * squared_distances(x, x))
    np.fill_diagonal(s, 0)
    degree = s.sum(1)
    root = np.sqrt(np.where(degree > 0, degree, 1.0))
    s /= root[:, None]
    s /= root[None]
    y = np.stack([label == 0, label == 1], 1).astype(float)
    f = y.copy()
    for _ in range(steps):
        f = (1 - keep) * s @ f + keep * y if keep < 1 else y
    total = f.sum(1, keepdims=True)
    return np.divide(f, total, out=np.zeros_like(f), where=total > 0)


def propagated(x: np.ndarray, label: np.ndarray, gamma: float = 0.25, keep: float = 0.8, steps: int = 200) -> np.ndarray:
    """P(1) of each row of the graph itself (see ``spread``)."""
    return spread(x, label, gamma, keep, steps)[:, 1]


def spread_to(x: np.ndarray, f: np.ndarray, new: np.ndarray, gamma: float = 0.25, block: int = 500) -> np.ndarray:
    """P(1) of rows outside the graph: the mean of its rows' probabilities by similarity; 0.5 if none has any.

    Distances are taken from the nearest row that has some, so that far rows don't lose all weights to rounding.
    """
    x, f = x[f.sum(1) > 0], f[f.sum(1) > 0]
    out = np.full(len(new), 0.5)
    for i in range(0, len(new) if len(x) else 0, block):
        d = squared_distances(new[i : i + block], x)
        w = np.exp(-gamma * (d - d.min(1, keepdims=True)))
        out[i : i + block] = w @ f[:, 1] / w.sum(1)
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Net:
    """Two hidden layers and a logistic head; a second head tells domains apart."""

    p: dict[str, np.ndarray]
    mean: np.ndarray = field(default_factory=lambda: np.zeros(1))
    scale: np.ndarray = field(default_factory=lambda: np.ones(1))
    shift: float = 0.0

    def hidden(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h1 = np.maximum(x @ self.p["w1"] + self.p["b1"], 0)
        return h1, np.maximum(h1 @ self.p["w2"] + self.p["b2"], 0)

    def standard(self, x: np.ndarray) -> np.ndarray:
        return (np.nan_to_num(x) - self.mean) / self.scale

    def predict(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.hidden(self.standard(x))[1] @ self.p["w3"] + self.p["b3"] + self.shift)


def adversarial(source: np.ndarray, label: np.ndarray, target: np.ndarray, weights: np.ndarray | None = None, conditional: bool = False, steps: int = 200, batch: int = 256, width: tuple[int, int] = (64, 32), rate: float = 3e-3, seed: int = 0, robust: float = 0.7, volume: np.ndarray | None = None) -> Net:
    """A classifier whose features don't tell source from target.

    Labels are noisy, so their loss is the generalised cross entropy (1 - p^q) / q of the label's probability p with
    q = ``robust``; 0 is the plain cross entropy. ``volume``: more rows of the source's domain, without labels, that only
    the domain head sees.

    The domain head learns to tell them apart and its gradient is reversed on its way into the features, with a weight
    that ramps up from 0 to 1. With ``conditional`` the head sees the products of features and class probabilities.
    Each domain is standardised by its own mean and deviation; the net predicts in the target's.
    """
    rng = np.random.default_rng(seed)
    stats = [(np.nanmean(x, 0), np.maximum(np.nanstd(x, 0), 1e-6)) for x in (source, target)]
    a, b = (np.nan_to_num((x - m) / s) for x, (m, s) in zip((source, target), stats, strict=True))
    extra = np.nan_to_num((volume - stats[0][0]) / stats[0][1]) if volume is not None and len(volume) else None
    net = Net(initial(a.shape[1], width, conditional, rng), *stats[1])
    moments = [{k: np.zeros_like(x) for k, x in net.p.items()} for _ in range(2)]
    r = np.ones(len(a)) if weights is None else weights / weights.mean()
    for t in range(1, steps + 1):
        i, j = rng.integers(0, len(a), min(batch, len(a))), rng.integers(0, len(b), min(batch, len(b)))
        more = extra[rng.integers(0, len(extra), min(batch, len(extra)))] if extra is not None else a[:0]
        x = np.vstack([a[i], more, b[j]])
        of_source = np.r_[np.ones(len(i) + len(more)), np.zeros(len(j))]
        descend(net.p, moments, gradients(net, x, label[i].astype(float), r[i] / len(i), of_source, len(x), reversal(t, steps), conditional, robust), t, rate)
    return net


def initial(n: int, width: tuple[int, int], conditional: bool, rng: np.random.Generator) -> dict[str, np.ndarray]:
    """Parameters of an unfitted net for ``n`` features, with its domain head."""
    k1, k2 = width
    dims = {"w1": (n, k1), "w2": (k1, k2), "w3": (k2,), "wd1": (k2 * (2 if conditional else 1), k2), "wd2": (k2,)}
    return {k: rng.normal(0, np.sqrt(2 / d[0]), d) for k, d in dims.items()} | {"b1": np.zeros(k1), "b2": np.zeros(k2), "b3": np.zeros(()), "bd1": np.zeros(k2), "bd2": np.zeros(())}


def reversal(t: int, steps: int) -> float:
    """The weight of the reversed gradient at a step."""
    return 2 / (1 + np.exp(-10 * t / steps)) - 1


def gradients(net: Net, x: np.ndarray, y: np.ndarray, w: np.ndarray, of_source: np.ndarray | float, rows: float, strength: float, conditional: bool, robust: float) -> dict[str, np.ndarray]:
    """Sums over standardised rows of the gradients of both losses (see ``adversarial``). The first ``len(y)`` rows have
    labels, which weigh ``w``; each row weighs 1 / ``rows`` in the domain's loss."""
    p, ns = net.p, len(y)
    h1, h2 = net.hidden(x)
    prob = _sigmoid(h2 @ p["w3"] + p["b3"])
    dz = np.zeros(len(x))
    own = np.maximum(np.where(y > 0.5, prob[:ns], 1 - prob[:ns]), 1e-7)
    dz[:ns] = w * own**robust * (prob[:ns] - y)
    both = np.hstack([h2 * prob[:, None], h2 * (1 - prob[:, None])]) if conditional else h2
    d1 = np.maximum(both @ p["wd1"] + p["bd1"], 0)
    dd = (_sigmoid(d1 @ p["wd2"] + p["bd2"]) - of_source) / rows
    back = np.outer(dd, p["wd2"]) * (d1 > 0)
    into = back @ p["wd1"].T
    if conditional:
        into = into[:, : h2.shape[1]] * prob[:, None] + into[:, h2.shape[1] :] * (1 - prob[:, None])
    dh2 = (np.outer(dz, p["w3"]) - strength * into) * (h2 > 0)
    dh1 = (dh2 @ p["w2"].T) * (h1 > 0)
    return {"w3": h2.T @ dz, "b3": dz.sum(), "wd2": d1.T @ dd, "bd2": dd.sum(), "wd1": both.T @ back, "bd1": back.sum(0), "w2": h1.T @ dh2, "b2": dh2.sum(0), "w1": x.T @ dh1, "b1": dh1.sum(0)}


def descend(p: dict[str, np.ndarray], moments: list[dict[str, np.ndarray]], g: dict[str, np.ndarray], t: int, rate: float) -> None:
    """One step of Adam, in place."""
    m, v = moments
    for k in p:
        m[k], v[k] = 0.9 * m[k] + 0.1 * g[k], 0.999 * v[k] + 0.001 * g[k] ** 2
        p[k] = p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)


def entropy(q: np.ndarray) -> np.ndarray:
    return -(q * np.log(q + 1e-9) + (1 - q) * np.log(1 - q + 1e-9))


def test_time_adapted(net: Net, target: np.ndarray, prior: float | None = None, neighbours: int = 10, gate: float = 0.65, rates: tuple[float, ...] = (1e-3, 3e-3, 1e-2), steps: int = 60, anchor: float = 1.0, most_shift: float = 3.0) -> Net:
    """The net fitted to unlabelled target rows: several rates, the surest result that doesn't collapse.

    The logit is first moved (by ``most_shift`` at most) so that the mean prediction meets the prior, if one is known.
    Then the head minimises the entropy of predictions smoothed over nearest neighbours in feature space, and is
    anchored to where it started. Rows surer than the gate count; if none is surer, the net stays as it is.
    """
    x = net.standard(target)
    h = net.hidden(x)[1]
    z = h @ net.p["w3"] + net.p["b3"]
    shift = 0.0
    if prior is not None:
        low, high = -most_shift, most_shift
        for _ in range(50):
            shift = (low + high) / 2
            low, high = (shift, high) if _sigmoid(z + shift).mean() < prior else (low, shift)
    near = None
    if neighbours and len(h) > neighbours:
        d = (h**2).sum(1)[:, None] + (h**2).sum(1)[None] - 2 * h @ h.T
        near = np.argpartition(d, neighbours, axis=1)[:, :neighbours]
    best, least = (net.p["w3"], net.p["b3"]), np.inf
    for rate in rates:
        w, b = net.p["w3"].copy(), net.p["b3"].copy()
        for _ in range(steps):
            q = _sigmoid(h @ w + b + shift)
            soft = q[near].mean(1) if near is not None else q
            sure = entropy(soft) < gate
            if not sure.any():
                break
            dz = np.where(sure, q - (soft >= 0.5), 0) / sure.sum()
            w -= rate * (h.T @ dz + anchor * (w - net.p["w3"]) / len(w))
            b = b - rate * dz.sum()
        q = _sigmoid(h @ w + b + shift)
        if 0.01 < (q >= 0.5).mean() < 0.99 and entropy(q).mean() < least:
            best, least = (w, b), entropy(q).mean()
    return Net(net.p | {"w3": best[0], "b3": best[1]}, net.mean, net.scale, shift)


test_time_adapted.__test__ = False
