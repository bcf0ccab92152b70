"""JSON log lines: debug and info to stdout, warn and error to stderr."""

from __future__ import annotations

import json
import sys
from datetime import UTC, datetime

from mediacat.config import LEVELS


class Logger:
    def __init__(self, level: str = "info", out=None, err=None):
        self.least, self.out, self.err = LEVELS.index(level), out, err

    def emit(self, level: str, message: str, **fields) -> None:
        rank = LEVELS.index(level)
        if rank >= self.least:
            line = json.dumps({"ts": datetime.now(UTC).isoformat(), "level": level, "msg": message, **fields}, default=str)
            print(line, file=(self.err or sys.stderr) if rank >= 2 else (self.out or sys.stdout), flush=True)


def exit_code(summary: dict) -> int:
    """1 where a run had failures, else 0."""
    return int(summary.get("failed", 0) > 0)
