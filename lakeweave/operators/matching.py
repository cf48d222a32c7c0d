"""Column names as vectors, and optimal one-to-one matching of columns."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class NameEncoder(Protocol):
    """Anything that turns names into unit vectors."""

    def encode(self, names: list[str]) -> np.ndarray: ...


class HashedNgramEncoder:
    """Names as hashed character n-grams of their words: similar spellings are near each other. Needs no model file."""

    def __init__(self, width: int = 256, grams: tuple[int, ...] = (3, 4)):
        self.width, self.grams = width, grams

    def encode(self, names: list[str]) -> np.ndarray:
        import re

        import xxhash

        out = np.zeros((len(names), self.width))
        for i, name in enumerate(names):
            plain = re.sub(r"([a-z])([A-Z])", r"\1 \2", name or "").lower()
            for word in re.split(r"[^a-z0-9]+", plain):
                if not word:
                    continue
                padded = f"^{word}$"
                parts = [padded] + [padded[k : k + n] for n in self.grams for k in range(len(padded) - n + 1)]
                for p in parts:
                    h = xxhash.xxh64_intdigest(p)
                    out[i, h % self.width] += (1.0 if h >> 63 else -1.0) / np.sqrt(len(parts))
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def encode_names(names: DataFrame, encoder: NameEncoder, column: str = "name") -> DataFrame:
    """``name, vector`` of the distinct names: each is encoded once, in batches."""

    vectors = _encoder_udf(encoder)
    return names.where(F.col(column).isNotNull()).select(F.col(column).alias("name")).distinct().select("name", vectors("name").alias("vector"))


def _encoder_udf(encoder: NameEncoder):
    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(list(encoder.encode(batch.tolist())), dtype=object)

    return run


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """The one-to-one pairs of rows and columns of least total cost, min(n, m) of them.

    Shortest augmenting paths with dual prices, one row at a time; columns of lower number win ties.
    """
    cost = np.asarray(cost, float)
    if cost.size == 0:
        return []
    if cost.shape[0] > cost.shape[1]:
        return sorted((i, j) for j, i in assign(cost.T))
    n, m = cost.shape
    row_price, col_price = np.zeros(n), np.zeros(m)
    owner = np.full(m, -1)
    for row in range(n):
        reach, via, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        at, base, last = row, 0.0, -1
        path = []
        while True:
            slack = base + cost[at] - row_price[at] - col_price
            better = ~done & (slack < reach)
            reach[better], via[better] = slack[better], last
            j = int(np.where(done, np.inf, reach).argmin())
            base = reach[j]
            done[j] = True
            path.append(j)
            if owner[j] < 0:
                break
            at, last = owner[j], j
        for j in path[:-1]:
            row_price[owner[j]] += base - reach[j]
            col_price[j] -= base - reach[j]
        row_price[row] += base
        j = path[-1]
        while j >= 0:
            before = via[j]
            owner[j] = owner[before] if before >= 0 else row
            j = before
    return sorted((int(i), j) for j, i in enumerate(owner) if i >= 0)


def match_columns(source: DataFrame, target: DataFrame, typed: bool = True, name_weight: float = 1.0, ks: DataFrame | None = None) -> DataFrame:
    """``table_id, src_col, tgt_col, sim``: for each table the best one-to-one matching of its columns to the target's.

    ``source``: table_id, name, is_num, vector; ``target``: name, is_num, vector (one table, sent to every task). The
    cost is 1 - cosine, blended with KS distances (``table_id, src_col, tgt_col, ks``) if ``name_weight`` is below 1.
    With ``typed`` numeric columns meet numeric ones only. A group is one table: some hundred columns at most.
    """
    tgt = target.select("name", "is_num", "vector").orderBy("name").toPandas()
    if ks is not None:
        source = source.join(ks.groupBy("table_id").agg(F.collect_list(F.struct("src_col", "tgt_col", "ks")).alias("_ks")), "table_id", "left")

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("name")
        gaps = {(x["src_col"], x["tgt_col"]): x["ks"] for x in (pdf["_ks"].iloc[0] if "_ks" in pdf and pdf["_ks"].iloc[0] is not None else [])}
        rows = []
        for kind in (True, False) if typed else (None,):
            a = pdf if kind is None else pdf[pdf["is_num"] == kind]
            b = tgt if kind is None else tgt[tgt["is_num"] == kind]
            if a.empty or b.empty:
                continue
            x, y = np.stack(a["vector"].to_list()), np.stack(b["vector"].to_list())
            sim = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)) @ (y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)).T
            cost = 1 - sim
            if name_weight < 1:
                gap = np.array([[gaps.get((s, t), 1.0) for t in b["name"]] for s in a["name"]])
                cost = name_weight * cost + (1 - name_weight) * gap
            rows += [(pdf["table_id"].iloc[0], a["name"].iloc[i], b["name"].iloc[j], round(float(sim[i, j]), 6)) for i, j in assign(cost)]
        return pd.DataFrame(rows, columns=["table_id", "src_col", "tgt_col", "sim"])

    kind = source.schema["table_id"].dataType.simpleString()
    return source.groupBy("table_id").applyInPandas(match, f"table_id {kind}, src_col string, tgt_col string, sim double")


def schema_similarity(matches: DataFrame) -> DataFrame:
    """``table_id, schema_sim``: the mean similarity of a table's matched columns."""
    return matches.groupBy("table_id").agg(F.round(F.avg("sim"), 6).alias("schema_sim"))


def distribution_matches(ks: DataFrame, n_target: int, near: float = 0.3) -> DataFrame:
    """``table_id, dist_sim``: columns matched by KS distance alone; the share of target columns whose match is near."""

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        grid = pdf.pivot(index="src_col", columns="tgt_col", values="ks").fillna(1.0)
        hits = sum(grid.to_numpy()[i, j] < near for i, j in assign(grid.to_numpy())) if len(grid) >= 2 else 0
        return pd.DataFrame([(pdf["table_id"].iloc[0], round(hits / n_target, 6))], columns=["table_id", "dist_sim"])

    kind = ks.schema["table_id"].dataType.simpleString()
    return ks.groupBy("table_id").applyInPandas(match, f"table_id {kind}, dist_sim double")
