"""Options of a scan, brought into their ranges before planning."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field, replace

DECISIONS = ("allow", "review", "block")


def _within(value: object, low: float, high: float, default: float) -> float:
    try:
        number = float(value)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return default
    return min(high, max(low, number)) if math.isfinite(number) else default


@dataclass(frozen=True)
class ScanOptions:
    """Thresholds, caps and hooks of a scan. ``normalised`` gives the values that hold."""

    block_threshold: float = 0.8
    review_threshold: float = 0.5
    max_length: int = 200_000
    cache_size: int = 512
    timeout_ms: int = 100
    classifier_timeout_ms: int = 2_000
    allowlist: tuple[str, ...] = ()
    mask_char: str = "*"
    classifier: Callable | None = field(default=None, compare=False)

    def normalised(self) -> ScanOptions:
        block = _within(self.block_threshold, 0, 1, 0.8)
        review = _within(self.review_threshold, 0, 1, 0.5)
        return replace(
            self,
            block_threshold=block,
            review_threshold=max(0.0, block - 0.001) if review >= block else review,
            max_length=int(_within(self.max_length, 100, 10_000_000, 200_000)),
            cache_size=int(_within(self.cache_size, 1, 10_000, 512)),
            timeout_ms=int(_within(self.timeout_ms, 1, 60_000, 100)),
            classifier_timeout_ms=int(_within(self.classifier_timeout_ms, 100, 30_000, 2_000)),
            allowlist=tuple(self.allowlist or ()),
            mask_char=self.mask_char if isinstance(self.mask_char, str) and self.mask_char else "*",
        )
