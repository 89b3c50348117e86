"""Search for parameters by tree-structured Parzen estimators, with a stored table of trials.

Trials are proposed in batches. Past trials fall into good ones (the best share) and others; each parameter has a density of either, a mixture of bells at the
values tried, as wide as their neighbours are far, and of a flat part. Of some draws from the good density the one with the best ratio of densities is
proposed. A batch is evaluated by one Spark job, whatever its size; the trials, a small table, are appended to a study, which a later search resumes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming.ledger import Folder


@dataclass(frozen=True)
class Integer:
    """A parameter from low to high, both included."""

    low: int
    high: int


@dataclass(frozen=True)
class TpeParams:
    """startup: random trials first. batch: proposed at once. good: share of the good. draws: candidates of each proposal."""

    startup: int = 20
    batch: int = 10
    good: float = 0.15
    draws: int = 48
    seed: int = 42


class Parzen:
    """The density of one parameter, from the values tried."""

    def __init__(self, values: np.ndarray, space: Integer):
        self.space, self.at = space, np.sort(np.asarray(values, float))
        wide = space.high - space.low + 1
        edges = np.concatenate([[space.low - 0.5], self.at, [space.high + 0.5]])
        near = np.maximum(edges[1:-1] - edges[:-2], edges[2:] - edges[1:-1]) if len(self.at) else np.zeros(0)
        self.width = np.clip(near, wide / min(100, 5 + len(self.at)), wide)

    def draw(self, rng: np.random.Generator, n: int) -> np.ndarray:
        which = rng.integers(0, len(self.at) + 1, n)  # the last is the flat part
        flat = rng.integers(self.space.low, self.space.high + 1, n).astype(float)
        if len(self.at):
            bell = rng.normal(self.at[np.minimum(which, len(self.at) - 1)], self.width[np.minimum(which, len(self.at) - 1)])
            flat = np.where(which < len(self.at), bell, flat)
        return np.clip(np.rint(flat), self.space.low, self.space.high)

    def log(self, x: np.ndarray) -> np.ndarray:
        flat = 1.0 / (self.space.high - self.space.low + 1)
        bells = np.exp(-0.5 * ((x[:, None] - self.at) / self.width) ** 2) / (self.width * np.sqrt(2 * np.pi))
        return np.log((bells.sum(1) + flat) / (len(self.at) + 1))


def propose(tried: list[tuple[dict[str, int], float]], space: dict[str, Integer], n: int, p: TpeParams) -> list[dict[str, int]]:
    """n new settings, none of which was tried, unless the space has no others. The same trials give the same proposals."""
    rng = np.random.default_rng([p.seed, len(tried)])
    seen = {tuple(t[k] for k in space) for t, _ in tried}
    room = int(np.prod([s.high - s.low + 1 for s in space.values()], dtype=float)) - len(seen)
    order = sorted(tried, key=lambda t: -t[1])
    good = order[: max(1, int(np.ceil(p.good * len(order))))]
    sides = {k: (Parzen(np.array([t[k] for t, _ in good]), s), Parzen(np.array([t[k] for t, _ in order[len(good) :]]), s)) for k, s in space.items()} if len(tried) >= p.startup else None
    out: list[dict[str, int]] = []
    while len(out) < min(n, max(room, 0)):
        if sides is None:
            drawn = {k: rng.integers(s.low, s.high + 1, p.draws) for k, s in space.items()}
            gain = np.zeros(p.draws)
        else:
            drawn = {k: l.draw(rng, p.draws) for k, (l, _) in sides.items()}
            gain = sum(l.log(drawn[k]) - g.log(drawn[k]) for k, (l, g) in sides.items())
        for i in np.argsort(-gain, kind="stable"):
            key = tuple(int(drawn[k][i]) for k in space)
            if key not in seen:
                seen.add(key)
                out.append(dict(zip(space, key)))
                break
        else:  # everything drawn is known: anywhere
            key = tuple(int(rng.integers(s.low, s.high + 1)) for s in space.values())
            if key not in seen:
                seen.add(key)
                out.append(dict(zip(space, key)))
    return out


class Study(Folder):
    """Trials of a search: trial, batch, params (a map) and value."""

    SCHEMA = "trial int, params map<string,int>, value double"

    def trials(self) -> DataFrame:
        last = self.last()
        if last < 0:
            return self.spark.createDataFrame([], f"{self.SCHEMA}, batch int")
        return self.spark.read.schema(f"{self.SCHEMA}, batch int").parquet(f"{self.path}/trials").filter(F.col("batch") <= last)

    def search(self, evaluate: Callable[[DataFrame], DataFrame], space: dict[str, Integer], trials: int, p: TpeParams = TpeParams()) -> None:
        """Go on until the study has so many trials. evaluate: from trial and a column of each parameter to trial and value, higher values better; a trial that it
        doesn't return, or whose value is null or NaN, counts as the worst."""
        tried = [(dict(r["params"]), r["value"]) for r in self.trials().orderBy("trial").collect()]
        while len(tried) < trials:
            n = min(p.batch if len(tried) >= p.startup else p.startup, trials - len(tried))
            new = propose(tried, space, n, p)
            if not new:
                return
            rows = [(len(tried) + i, *x.values()) for i, x in enumerate(new)]
            asked = self.spark.createDataFrame(rows, "trial int, " + ", ".join(f"{k} int" for k in space))
            value = {r["trial"]: r["value"] for r in evaluate(asked).select("trial", "value").collect()}
            values = [v if (v := value.get(r[0])) is not None and v == v else float("-inf") for r in rows]
            batch = self.last() + 1
            done = self.spark.createDataFrame([(r[0], x, float(v)) for r, x, v in zip(rows, new, values)], self.SCHEMA)
            done.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/trials/batch={batch}")
            self.commit(batch)
            tried += list(zip(new, values))


def best(trials: DataFrame) -> DataFrame:
    """The best trial, the first of equals."""
    return trials.orderBy(F.desc("value"), "trial").limit(1)


def plateau(trials: DataFrame, share: float = 0.1, least: int = 5) -> DataFrame:
    """One row: the best value, how many trials come within `share` of it, and whether they are enough for a plateau instead of a spike."""
    top = trials.agg(F.max("value").alias("b")).scalar()
    near = trials.withColumn("_b", top).agg(F.max("value").alias("best"), F.count("*").alias("trials"), F.count_if(F.col("value") >= F.col("_b") - share * F.abs("_b")).alias("near"))
    return near.withColumn("plateau", F.col("near") >= least)
