"""A registry of bandit models: candidates, gated promotion by compare-and-swap, rollback, and a guarded load.

``candidates`` has a row a problem, version and arm with what the model has learned of the arm; ``active`` a row a
promotion or rollback. Both are tables of one snapshot store, so a promotion is there whole or not at all, and of two
that start from the same state one is refused.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmart.operators import policy
from quillmart.sources.snapshots import Conflict, Snapshots, Version

#: Versions that only ever run in the shadow, the version of a model that has learned nothing.
SHADOW_ONLY, COLD = ("backfill-v1",), "coldstart-v1"
CANDIDATES = "problem string, version string, n long, arm string, place int, dim int, a array<double>, b array<double>"
ACTIVE = "problem string, n long, version string, previous string, approved_by string, kind string"


class Refused(ValueError):
    """A promotion or rollback that the rules don't allow; ``reasons`` says why."""

    def __init__(self, *reasons: str):
        super().__init__(", ".join(reasons))
        self.reasons = reasons


@dataclass(frozen=True)
class Loaded:
    model: policy.Bandit
    version: str
    active: bool


class Models:
    def __init__(self, spark: SparkSession, path: str, **how):
        self.spark, self.store = spark, Snapshots(spark, path, **how)

    def _active(self, problem: str, at: Version | None = None):
        rows = self.store.read("active", ACTIVE, at).where(F.col("problem") == problem)
        return rows.orderBy(F.col("n").desc()).first()

    def save(self, problem: str, version: str, model: policy.Bandit) -> None:
        """A candidate; a version is saved once and never changed."""

        def work(at: Version):
            known = self.store.read("candidates", CANDIDATES, at).where(F.col("problem") == problem)
            if not known.where(F.col("version") == version).isEmpty():
                raise Refused("version exists")
            n = 1 + (known.agg(F.max("n").alias("n")).first()["n"] or 0)
            rows = [(problem, version, n, a, i, len(model.b[a]), model.a[a].ravel().tolist(), model.b[a].tolist()) for i, a in enumerate(model.arms)]
            return {"candidates": ("add", self.spark.createDataFrame(rows, CANDIDATES).coalesce(1))}

        self.store.change(work)

    def latest(self, problem: str) -> str | None:
        """The version saved last."""
        row = self.store.read("candidates", CANDIDATES).where(F.col("problem") == problem).orderBy(F.col("n").desc()).first()
        return row and row["version"]

    def model(self, problem: str, version: str, at: Version | None = None) -> policy.Bandit | None:
        rows = self.store.read("candidates", CANDIDATES, at).where((F.col("problem") == problem) & (F.col("version") == version))
        found = sorted(rows.collect(), key=lambda r: r["place"])  # a row an arm
        if not found:
            return None
        d = found[0]["dim"]
        return policy.Bandit([r["arm"] for r in found], {r["arm"]: np.array(r["a"]).reshape(d, d) for r in found}, {r["arm"]: np.array(r["b"]) for r in found})

    def promote(self, problem: str, version: str, *, approved_by: str, log: DataFrame, context: list[str], arms: list[str], expected: str | None = None) -> str:
        """Make a candidate the active model; returns the one it replaces, or "".

        It needs somebody's name, a saved candidate that may act, a log of decisions that passes ``policy.activation``,
        and, with ``expected``, that the active version is still that one.
        """
        if not approved_by:
            raise Refused("approval")
        if version in SHADOW_ONLY:
            raise Refused("shadow only")
        gate = policy.activation(log, context, self.spark.createDataFrame([(a,) for a in arms], "arm string")).first()
        if not gate["active"]:
            raise Refused(*gate["reasons"].split(","))
        replaced = ""

        def work(at: Version):
            nonlocal replaced
            if self.model(problem, version, at) is None:
                raise Refused("no such candidate")
            now = self._active(problem, at)
            replaced = now["version"] if now else ""
            if expected is not None and replaced != expected:
                raise Refused(f"{replaced or 'nothing'} is active")
            return self._moved(problem, now, version, replaced or None, approved_by, "promotion")

        self.store.change(work)
        return replaced

    def rollback(self, problem: str, *, approved_by: str) -> str:
        """Make the version before the latest promotion active again; returns it. Doing it again changes nothing."""
        back = ""

        def work(at: Version):
            nonlocal back
            now = self._active(problem, at)
            if now is None or now["previous"] is None:
                raise Refused("no version before")
            back = now["previous"]
            return {} if now["version"] == back else self._moved(problem, now, back, back, approved_by, "rollback")

        self.store.change(work)
        return back

    def _moved(self, problem: str, now, version: str, previous: str | None, by: str, kind: str):
        row = (problem, 1 + (now["n"] if now else 0), version, previous, by, kind)
        return {"active": ("add", self.spark.createDataFrame([row], ACTIVE).coalesce(1))}

    def load(self, problem: str, context: list[str], arms: list[str], ridge: float = 1.0) -> Loaded:
        """The active model, or one that has learned nothing where there is none or it is for other arms, another order of them or another context."""
        at, d = self.store.version(), len(context) + 1
        now = self._active(problem, at)
        if now is not None and now["version"] not in SHADOW_ONLY:
            model = self.model(problem, now["version"], at)
            if model is not None and model.arms == list(arms) and all(len(model.b[a]) == d for a in arms):
                return Loaded(model, now["version"], True)
        return Loaded(policy.Bandit(list(arms), {a: ridge * np.eye(d) for a in arms}, {a: np.zeros(d) for a in arms}), COLD, False)


__all__ = ["ACTIVE", "CANDIDATES", "COLD", "Conflict", "Loaded", "Models", "Refused", "SHADOW_ONLY"]
