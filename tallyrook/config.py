"""Parameters of mining, clustering and planning."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

# Phrases of correction, searched in lower-cased text.
CORRECTION_REGEX = r"(\bno\b|\bdon.?t\b|\bactually\b|\brevert\b|that.?s wrong|\bwrong\b|\bundo\b|\bnope\b|incorrect|\bstop\b)"
INTERRUPTED = "request interrupted"
ARTIFACT_NAME = "CLAUDE.md"


@dataclass(frozen=True)
class MineConfig:
    window_before: int = 3
    window_after: int = 4
    excerpt_chars: int = 300
    large_file_lines: int = 300
    medium_lines: int = 500
    high_lines: int = 1000
    retry_window_turns: int = 5
    correction_lookback: int = 2
    correction_regex: str = CORRECTION_REGEX
    global_artifact: str = field(default_factory=lambda: os.path.join(os.path.expanduser("~"), ".claude", ARTIFACT_NAME))
    signals: tuple[str, ...] = ()
    since: str = ""
    #: True numbers turns after the since filter, as the reference does; ids then depend on it.
    compat_since: bool = False


@dataclass(frozen=True)
class ClusterConfig:
    min_sessions: int = 5
    max_incidents: int = 50
    top: int = 0
    max_content_bytes: int = 12 * 1024
    max_excerpt_bytes: int = 1500
    max_window_turns: int = 4
    max_incidents_per_cluster: int = 25
    truncation_mark: str = "\n…[truncated]"


@dataclass(frozen=True)
class PlanConfig:
    include_low_confidence: bool = False
    settings_repo: str = ""
    branch_name: str = "tallyrook"
    #: (part of the origin's URL, owner), the first that fits
    owners: tuple[tuple[str, str], ...] = ()
    default_owner: str = "personal"
    immutable_prefix: str = "/nix/store/"
    pr_placeholder: str = "<!-- PR link goes here -->"
