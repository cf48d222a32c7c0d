"""The nets of ``neural`` fitted to all rows: these stay on the executors in blocks, and only sums of gradients meet."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweave.operators import adapt, neural
from lakeweave.operators.neural import Net

#: rows of a block, and tasks that share the rows of a step at most
BLOCK, MOST_TASKS = 2000, 64
SOURCE, VOLUME, TARGET = range(3)


def filled(df: DataFrame, features: Sequence[str], middle: dict[str, float]) -> DataFrame:
    """The features as doubles, with the given medians for missing values."""
    return df.withColumns({c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(float(middle[c]))) for c in features})


def parts_of(rows: int, steps: int, batch: int) -> int:
    """How many parts take turns over the steps: as many as leave ``batch`` rows to each, and a divisor of the steps, so that
    every row takes part equally often, and at least once."""
    return max(k for k in range(1, steps + 1) if steps % k == 0 and (k == 1 or k * batch <= rows))


def _packed(df: DataFrame, features: Sequence[str], keys: Sequence[str], y: str, w: str) -> RDD:
    """((keys), (x, y, w)) of each block, whose rows are in an order of their own, so that repeated runs agree."""
    names = [f"_x{i}" for i in range(len(features))]
    rows = df.select(*keys, *[F.col(c).alias(n) for c, n in zip(features, names, strict=True)], F.col(y).cast("double").alias("_y"), F.col(w).cast("double").alias("_w"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        values = pdf[[*names, "_y", "_w"]].to_numpy(float)
        values = np.ascontiguousarray(values[np.lexsort(values.T)])
        return pd.DataFrame([{k: pdf[k].iloc[0] for k in keys} | {"rows": values.tobytes()}])

    packed = rows.groupBy(*keys).applyInPandas(pack, ", ".join(f"{k} int" for k in keys) + ", rows binary")

    def unpack(r) -> tuple:
        values = np.frombuffer(r["rows"]).reshape(-1, len(names) + 2)
        return tuple(r[k] for k in keys), (values[:, :-2], values[:, -2], values[:, -1])

    return packed.rdd.map(unpack)


def _added(a: dict, b: dict) -> dict:
    return {k: a[k] + b[k] if k in a and k in b else a.get(k, b.get(k)) for k in a | b}


def _summed(blocks: RDD, one: Callable[[tuple, tuple], dict | None], partitions: Sequence[int] | None = None) -> dict:
    """What ``one`` makes of each block, added up in the order of their keys."""

    def run(rows: Iterable) -> Iterable:
        found = sorted(((key, got) for key, block in rows if (got := one(key, block)) is not None), key=lambda x: x[0])
        return [(found[0][0], reduce(_added, (g for _, g in found)))] if found else []

    return reduce(_added, (g for _, g in sorted(blocks.context.runJob(blocks, run, partitions), key=lambda x: x[0])), {})


def adversarial(sources: DataFrame, target: DataFrame, features: Sequence[str], volume: DataFrame | None = None, kinds: Sequence[bool] = (False, True), steps: int = 200, batch: int = 256, width: tuple[int, int] = (64, 32), rate: float = 3e-3, seed: int = 0, robust: float = 0.7) -> tuple[list[Net], float]:
    """(nets, the share of 1 among the source rows): ``neural.adversarial`` for each of ``kinds`` (conditional or not), fitted
    to every row of ``sources``, ``target`` and ``volume``.

    The rows of a domain are dealt to parts (``parts_of``) that take turns, so a step has ``batch`` rows or more of each domain
    and all steps together have every row, all rows of a domain equally often. Each domain weighs the same in the domain
    head's loss. Features have no missing values (``filled``).
    """
    names = list(features)
    frames = {SOURCE: sources.where("label is not null").withColumns({"_y": F.col("label"), "_w": F.coalesce("weight", F.lit(0.0))})}
    frames |= {d: df.withColumns({"_y": F.lit(0.0), "_w": F.lit(1.0)}) for d, df in ((VOLUME, volume), (TARGET, target)) if df is not None}
    sizes = {d: df.count() for d, df in frames.items()}
    parts = {d: parts_of(n, steps, batch) for d, n in sizes.items()}
    tasks = max(1, min(MOST_TASKS, max(-(-n // (parts[d] * BLOCK)) for d, n in sizes.items())))
    rows = None
    for d, df in frames.items():
        own = [F.col("row_id").cast("string"), *[F.col(c) for c in names]]
        at = {"_domain": F.lit(d), "_part": F.pmod(F.xxhash64(*own), F.lit(parts[d])).cast("int"), "_block": F.pmod(F.xxhash64(F.lit("block"), *own), F.lit(max(1, -(-sizes[d] // (parts[d] * BLOCK))))).cast("int")}
        one = df.withColumns(at).select(*at, *names, "_y", "_w")
        rows = one if rows is None else rows.unionByName(one)
    packed = _packed(rows, names, ("_domain", "_part", "_block"), "_y", "_w").map(lambda b: (b[0][1] * tasks + b[0][2] % tasks, b))
    blocks = packed.partitionBy(max(parts.values()) * tasks, lambda slot: slot).values().persist(StorageLevel.MEMORY_AND_DISK)
    found = _summed(blocks, lambda key, b: {("n", *key[:2]): len(b[0]), ("x", key[0]): b[0].sum(0), ("y", key[0]): b[1].sum(), ("w", key[0]): b[2].sum()})
    n = {d: sum(v for k, v in found.items() if k[:2] == ("n", d)) for d in frames}
    mean = {d: found[("x", d)] / n[d] if n[d] else np.zeros(len(names)) for d in frames}
    squares = _summed(blocks, lambda key, b: {key[0]: ((b[0] - mean[key[0]]) ** 2).sum(0)})
    scale = {d: np.maximum(np.sqrt(squares[d] / n[d]), 1e-6) if n[d] else np.ones(len(names)) for d in frames}
    if VOLUME in frames:
        mean[VOLUME], scale[VOLUME] = mean[SOURCE], scale[SOURCE]
    heavy = found[("w", SOURCE)] / n[SOURCE] if n[SOURCE] and found[("w", SOURCE)] else 1.0
    domains = sum(1 for d in frames if n[d])
    nets = [Net(neural.initial(len(names), width, c, np.random.default_rng(seed)), mean[TARGET], scale[TARGET]) for c in kinds]
    moments = [[{k: np.zeros_like(x) for k, x in net.p.items()} for _ in range(2)] for net in nets]
    for t in range(1, steps + 1):
        turn = {d: t % k for d, k in parts.items()}
        size = {d: found.get(("n", d, turn[d]), 0) for d in frames}

        def one(key: tuple, block: tuple, t=t, turn=turn, size=size, nets=nets) -> dict | None:
            d = key[0]
            if turn[d] != key[1]:
                return None
            x, y, w = block
            x = (x - mean[d]) / scale[d]
            y, w = (y, w / heavy / size[d]) if d == SOURCE else (y[:0], w[:0])
            each = [neural.gradients(net, x, y, w, float(d != TARGET), domains * size[d], neural.reversal(t, steps), c, robust) for net, c in zip(nets, kinds, strict=True)]
            return {(i, k): v for i, g in enumerate(each) for k, v in g.items()}

        slots = sorted({part * tasks + i for part in turn.values() for i in range(tasks)})
        sums = _summed(blocks, one, slots)
        for i, (net, own) in enumerate(zip(nets, moments, strict=True)):
            if sums:
                neural.descend(net.p, own, {k: sums[i, k] for k in net.p}, t, rate)
    blocks.unpersist()
    return nets, float(found[("y", SOURCE)] / n[SOURCE]) if n[SOURCE] else 0.5


def _augmented(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows as queries and as data, whose products are squared distances."""
    square, one = (h**2).sum(1)[:, None], np.ones((len(h), 1))
    return np.hstack([-2 * h, square, one]), np.hstack([h, one, square])


def _closer(best: tuple[np.ndarray, np.ndarray], d: np.ndarray, about: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``best`` (distances, about: rows x k) after a look at more rows: their distances ``d`` and what is told ``about`` each.
    Of equally near rows those seen first stay."""
    held, told = best
    k = held.shape[1]
    most = held[:, -1:]
    if np.isinf(most).any():  # nothing to go by yet
        j = np.argpartition(d, k - 1, axis=1)[:, :k] if d.shape[1] > k else np.broadcast_to(np.arange(d.shape[1]), d.shape)
        near = np.take_along_axis(d, j, 1) < most
        i, j = np.nonzero(near)[0], j[near]
    else:
        i, j = np.nonzero(d < most)
    rows = np.unique(i)
    if not len(rows):
        return best
    r = np.r_[np.repeat(rows, k), i]
    far, what = np.r_[held[rows].ravel(), d[i, j]], np.vstack([told[rows].reshape(len(rows) * k, -1), about[j]])
    order = np.lexsort((what[:, 0], far, r))
    first = np.searchsorted(r[order], rows)[:, None] + np.arange(k)
    held[rows], told[rows] = far[order][first], what[order][first]
    return held, told


def neighbours_of(blocks: RDD, n_blocks: int, net: Net, k: int) -> RDD:
    """(key, (x, n, near, share)) for blocks of distinct rows that come ``n`` times: the features of the distinct rows that
    hold the ``k`` nearest rows of each in the net's feature space, itself included, and what share of k each holds.

    Every block meets every other, so the time grows with the square of the distinct rows; a task holds a block and the k
    best so far of its rows.
    """
    whole = blocks.coalesce(max(1, n_blocks // 1000))  # some 80 MB of five features

    def candidates(pairs: Iterable) -> Iterable:
        best, hidden = {}, {}
        for (key, (x, n, _)), (other, (z, m, _)) in pairs:
            if key not in best:
                hidden[key] = _augmented(net.hidden(net.standard(x))[1])[0]
                best[key] = x, n, np.full((len(x), k), np.inf), np.zeros((len(x), k, z.shape[1] + 2))
            about = np.hstack([(other[0] * float(1 << 24) + np.arange(len(z)))[:, None], m[:, None], z])
            d = np.maximum(hidden[key] @ _augmented(net.hidden(net.standard(z))[1])[1].T, 0)
            best[key] = (*best[key][:2], *_closer(best[key][2:], d, about))
        return best.items()

    def merged(a: tuple, b: tuple) -> tuple:
        d, about = np.hstack([a[2], b[2]]), np.concatenate([a[3], b[3]], 1)
        order = np.lexsort((about[:, :, 0], d))[:, :k]
        return a[0], a[1], np.take_along_axis(d, order, 1), np.take_along_axis(about, order[:, :, None], 1)

    def shares(found: tuple) -> tuple:
        x, n, d, about = found
        m = np.where(np.isinf(d), 0, about[:, :, 1])
        before = np.cumsum(m, 1) - m
        return x, n, about[:, :, 2:], np.clip(k - before, 0, m) / k

    met = blocks.cartesian(whole).mapPartitions(candidates)
    return met.reduceByKey(merged, max(1, min(n_blocks, 2 * blocks.context.defaultParallelism))).mapValues(shares)


def test_time_adapted(net: Net, target: DataFrame, features: Sequence[str], prior: float | None = None, neighbours: int = 10, gate: float = 0.65, rates: tuple[float, ...] = (1e-3, 3e-3, 1e-2), steps: int = 60, anchor: float = 1.0, most_shift: float = 3.0) -> Net:
    """``neural.test_time_adapted`` on every row of ``target``. Equal rows are kept once, with their number."""
    names = list(features)
    counted = adapt.stored(target.groupBy(*names).agg(F.count(F.lit(1)).alias("_n")))
    size = counted.agg(F.count(F.lit(1)).alias("distinct"), F.sum("_n").alias("n")).first()
    total, n_blocks = size["n"] or 0, max(1, -(-size["distinct"] // BLOCK))
    if not total:
        return net
    keyed = counted.withColumn("_block", F.pmod(F.xxhash64(*names), F.lit(n_blocks)).cast("int"))
    blocks = _packed(keyed, names, ("_block",), "_n", "_n").map(lambda b: (b[0][0], b)).partitionBy(n_blocks, lambda i: i).values().persist(StorageLevel.MEMORY_AND_DISK)
    feature = lambda x: net.hidden(net.standard(x))[1]
    w0, b0 = net.p["w3"], net.p["b3"]
    shift = 0.0
    if prior is not None:
        low, high = -most_shift, most_shift
        for _ in range(10):  # the fiftieth half of the range, 32 parts at a time
            ends = np.linspace(low, high, 33)
            means = _summed(blocks, lambda _, b, ends=ends: {"p": b[1] @ neural._sigmoid((feature(b[0]) @ w0 + b0)[:, None] + ends[1:-1])})["p"] / total
            at = int((means < prior).sum())
            low, high = ends[at], ends[at + 1]
        shift = (low + high) / 2
    near = None
    if neighbours and total > neighbours:
        near = neighbours_of(blocks, n_blocks, net, neighbours).persist(StorageLevel.MEMORY_AND_DISK)
    held = blocks.mapValues(lambda b: (b[0], b[1], None, None)) if near is None else near
    heads = {i: (w0.copy(), b0.copy()) for i in range(len(rates))}
    moving = set(heads)

    def one(_: tuple, block: tuple) -> dict:
        x, n, others, share = block
        h = feature(x)
        around = None if others is None else feature(others.reshape(-1, x.shape[1]))
        out = {}
        for i in moving:
            w, b = heads[i]
            q = neural._sigmoid(h @ w + b + shift)
            soft = q if around is None else (neural._sigmoid(around @ w + b + shift).reshape(share.shape) * share).sum(1)
            sure = n * (neural.entropy(soft) < gate)
            dz = sure * (q - (soft >= 0.5))
            out |= {(i, "w"): h.T @ dz, (i, "b"): dz.sum(), (i, "sure"): sure.sum()}
        return out

    for _ in range(steps):
        if not moving:
            break
        sums = _summed(held, one)
        moving = {i for i in moving if sums[i, "sure"]}
        for i in moving:
            w, b = heads[i]
            sure = sums[i, "sure"]
            heads[i] = (w - rates[i] * (sums[i, "w"] / sure + anchor * (w - w0) / len(w)), b - rates[i] * sums[i, "b"] / sure)

    def judged(_: tuple, block: tuple) -> dict:
        h, n = feature(block[0]), block[1]
        each = {i: neural._sigmoid(h @ w + b + shift) for i, (w, b) in heads.items()}
        return {(i, k): v for i, q in each.items() for k, v in (("ones", n @ (q >= 0.5)), ("entropy", n @ neural.entropy(q)))}

    last = _summed(blocks, judged)
    good = [i for i in heads if 0.01 < last[i, "ones"] / total < 0.99]
    best = heads[min(good, key=lambda i: (last[i, "entropy"], i))] if good else (w0, b0)
    for kept in (blocks, near):
        if kept is not None:
            kept.unpersist()
    return Net(net.p | {"w3": best[0], "b3": best[1]}, net.mean, net.scale, shift)


test_time_adapted.__test__ = False
