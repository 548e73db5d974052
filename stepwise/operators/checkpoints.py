"""When an iteration compacts its history."""

from __future__ import annotations

import warnings
from dataclasses import dataclass


@dataclass(frozen=True)
class Never:
    def last(self, step: int, inclusive: bool = True) -> int | None:
        return None

    def is_active(self, step: int) -> bool:
        return False


@dataclass(frozen=True)
class AtSteps:
    """Compact at the listed steps, counted from 0."""

    steps: tuple[int, ...]

    def last(self, step: int, inclusive: bool = True) -> int | None:
        return max((c for c in self.steps if c < step or inclusive and c == step), default=None)

    def is_active(self, step: int) -> bool:
        return step in self.steps


def from_conf(text: str | None, total: int | None = None) -> Never | AtSteps:
    """From a comma-separated list; nothing listed is never."""
    steps = tuple(int(x) for x in (text or "").split(",") if x.strip())
    if total is not None and any(s >= total for s in steps):
        warnings.warn(f"checkpoints beyond the last step {total - 1} are never active", stacklevel=2)
    return AtSteps(steps) if steps else Never()
