"""Hop units: transforms of dilated neighbourhoods, one for each channel that is passed on, or one for all channels together.

A unit knows which channels of the hop before it took, their transforms, and the energies of its own channels (a channel's share times the
energy of the one it comes from). Hops form a chain: each is fitted on what those before make of an image, in two passes over the images
(the windows' moments, then the largest response, which is the bias). From the second hop on the bias goes in before a transform and
off its first channel after it. Units are kept by sources/models.py.

Defined cases: images without pixels take no part; an empty table gives no units; a hop that no channel is passed to ends the chain."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.functions import grid
from pixelloom.operators.subspace import Saab, moments
from pixelloom.operators.windows import per_image


@dataclass
class HopUnit:
    reach: int
    dilate: int
    channelwise: bool
    passed: list[int]
    saabs: list[Saab] = field(default_factory=list)
    energy: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def windows(self, x: np.ndarray) -> list[np.ndarray]:
        """Windows of each channel that is passed on, or of all together."""
        if not self.channelwise:
            return [grid.neighbours(x, self.reach, self.dilate)]
        return [grid.neighbours(x[:, :, c : c + 1], self.reach, self.dilate) for c in self.passed]

    def apply(self, x: np.ndarray, bias: bool) -> np.ndarray:
        out = []
        for s, v in zip(self.saabs, self.windows(x)):
            y = (v + (s.bias if bias else 0.0)) @ s.kernels.T
            if bias:
                y[:, :, 0] -= s.bias
            out.append(y)
        return np.concatenate(out, axis=2)


@dataclass
class HopChain:
    units: list[HopUnit] = field(default_factory=list)

    def responses(self, x: np.ndarray) -> list[np.ndarray]:
        out = []
        for k, u in enumerate(self.units):
            x = u.apply(x, k > 0)
            out.append(x)
        return out

    def transform(self, images: DataFrame) -> DataFrame:
        """Images of the last hop's responses, in one pass."""
        return per_image(images.where("px is not null"), lambda x: self.responses(x)[-1] if self.units else x[:, :, :0])

    def table(self, spark: SparkSession) -> DataFrame:
        """(hop, parent, channel, energy): parent is the channel of the hop before, -1 for all together."""
        rows = []
        for k, u in enumerate(self.units):
            parents = [c for s, c in zip(u.saabs, u.passed if u.channelwise else [-1]) for _ in s.kernels]
            rows += [(k, int(p), j, float(e)) for j, (p, e) in enumerate(zip(parents, u.energy))]
        return spark.createDataFrame(rows, "hop long, parent long, channel long, energy double")


def fit_chain(images: DataFrame, hops: list[dict], energy_percent: float = 0.98, passes: Callable[[np.ndarray], np.ndarray] | None = None) -> HopChain:
    """hops: reach, dilate and channelwise of each. energy_percent: as many kernels of a transform as keep this share. passes: which channels
    of a hop go on, from their energies; all by default."""
    rows, chain = images.where("px is not null"), HopChain()
    first = rows.select("c").first()
    if first is None:
        return chain
    for k, hop in enumerate(hops):
        before = chain.units[-1].energy if k else np.ones(first[0])
        passed = np.arange(len(before)) if not k or passes is None else np.flatnonzero(passes(before))
        if not len(passed):
            break
        unit = HopUnit(hop.get("reach", 2), hop.get("dilate", 1), hop.get("channelwise", True), passed.tolist())

        def cut(b: pd.DataFrame, then: Callable[[int, np.ndarray], np.ndarray] = lambda u, v: v, unit=unit) -> dict[int, np.ndarray]:
            out: dict[int, list] = {}
            for p, h, w, c in zip(b["px"], b["h"], b["w"], b["c"]):
                x = grid.as_image(p, h, w, c)
                for v in chain.responses(x)[-1:]:
                    x = v
                for u, v in enumerate(unit.windows(x)):
                    out.setdefault(u, []).append(then(u, v.reshape(-1, v.shape[-1])))
            return {u: np.concatenate(v) for u, v in out.items()}

        columns = ["h", "w", "c", "px"]
        found = moments(rows, cut, columns)
        saabs = [Saab.from_moments(found[u], variant="v1", energy_percent=energy_percent) for u in sorted(found)]
        largest = moments(rows, lambda b: cut(b, lambda u, v: (v - saabs[u].mean) @ saabs[u].kernels.T), columns)  # noqa: B023
        for u, s in enumerate(saabs):
            s.bias = largest[u].norm
        unit.saabs = saabs
        parents = before[passed] if unit.channelwise else np.ones(1)
        unit.energy = np.concatenate([s.energy * e for s, e in zip(saabs, parents)])
        chain.units.append(unit)
    return chain


def below(threshold: float) -> Callable[[np.ndarray], np.ndarray]:
    """Channels of less energy go on."""
    return lambda energy: energy < threshold


def above(threshold: float) -> Callable[[np.ndarray], np.ndarray]:
    """Channels of more energy go on."""
    return lambda energy: energy > threshold
