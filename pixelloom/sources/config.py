"""Settings of a feature-learning run as one record."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np


@dataclass(frozen=True)
class HopSpec:
    """One hop: window, stride, pooling before it, and its subspace transform."""

    window: int = 5
    stride: int = 1
    border: str | None = "symmetric"
    pool: str | None = None
    kernels: int = -1
    use_dc: bool = True
    need_bias: bool = True
    channelwise: bool = True
    #: Instead of the windows above: (h x w x channels, hop) -> rows x columns x features, and its inverse.
    gather: Callable[[np.ndarray, HopSpec], np.ndarray] | None = None
    ungather: Callable[[np.ndarray, HopSpec], np.ndarray] | None = None


@dataclass(frozen=True)
class RunConfig:
    """Folders and thresholds of a run."""

    cover_dir: str = ""
    stego_dir: str = ""
    cost_path: str = ""
    model_dir: str = ""
    images: int | None = None
    split_threshold: float = 0.005
    keep_threshold: float = 0.0005
    roi_share: float = 0.05
    hops: tuple[HopSpec, ...] = field(default_factory=lambda: (HopSpec(),))
