"""Scan options, presets and their checks; all of it runs before any job."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

MODES = ("all", "same_family", "cross_family", "language_pairs")


@dataclass(frozen=True)
class Options:
    threshold: float = 0.70
    min_tokens: int = 12
    max_groups: int = 100
    max_occurrences: int = 20
    max_pairs: int = 5_000_000
    mode: str = "all"
    language_pairs: tuple[tuple[str, str], ...] = ()
    focus_active: bool = False
    focused_only: bool = False
    ranking: str = "structural"
    statement_blocks: bool = False
    block_statements: int = 3
    max_blocks_per_function: int = 64
    max_file_bytes: int = 2 << 20
    domains: tuple[str, ...] = ()
    priority_paths: tuple[tuple[str, int], ...] = ()
    roots: tuple[str, ...] = ()
    same_language_only: bool = False
    exclude_generated: bool = False
    require_coverage: bool = False
    require_focus: bool = False
    min_file_coverage: float = 0.0
    max_zero_files: int = -1
    fail_on_warning: bool = False
    fail_on_diagnostic: bool = False

    def __post_init__(self) -> None:
        if not math.isfinite(self.threshold) or not 0 < self.threshold <= 1:
            raise ValueError("threshold must be above 0 and at most 1")
        if self.min_tokens < 1:
            raise ValueError("min_tokens must be at least 1")
        if min(self.max_groups, self.max_occurrences, self.max_pairs, self.max_file_bytes) < 0:
            raise ValueError("limits cannot be negative")
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}")
        if (self.mode == "language_pairs") != bool(self.language_pairs):
            raise ValueError("language_pairs go with the mode of that name, and with no other")
        if not 0 <= self.min_file_coverage <= 1:
            raise ValueError("min_file_coverage is a share")
        for root in self.roots:
            if not root or root.startswith("/") or ".." in root.split("/"):
                raise ValueError("roots are relative paths within the project")
        if self.focused_only and not self.focus_active:
            raise ValueError("focused_only needs a focus")
        if self.ranking not in ("structural", "review"):
            raise ValueError("ranking is structural or review")
        if self.statement_blocks and (self.block_statements < 2 or self.max_blocks_per_function < 1):
            raise ValueError("a block has 2 statements or more, a function 1 block or more")
        if len(self.priority_paths) > 32 or any(not 1 <= w <= 100 for _, w in self.priority_paths):
            raise ValueError("at most 32 path rules with weights from 1 to 100")


#: The presets of the three review workflows.
PRESETS = {
    "review": Options(
        threshold=0.85, min_tokens=40, max_groups=250, max_occurrences=10, domains=("code",), ranking="review", mode="same_family", same_language_only=True,
        require_coverage=True, exclude_generated=True,
    ),
    "explore": Options(),
    "sql": Options(max_groups=250, max_occurrences=10, domains=("sql-query",), ranking="review", require_coverage=True, exclude_generated=True),
}


def preset(name: str, **changes: object) -> Options:
    if name not in PRESETS:
        raise ValueError(f"no preset {name}; there are {sorted(PRESETS)}")
    return replace(PRESETS[name], **changes)


def scoped(options: Options, scopes: dict[str, dict], name: str) -> Options:
    """Options of a named scope: its root prefixes and overrides."""
    if name not in scopes:
        raise ValueError(f"no scope {name}")
    return replace(options, **scopes[name])
