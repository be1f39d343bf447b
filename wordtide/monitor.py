"""Processor and memory use of the driver's machine while a query runs, sampled from /proc where there is one."""

from __future__ import annotations

import threading
from collections.abc import Callable
from pathlib import Path


class SystemMonitor:
    """As a context: calls ``report(cpu_percent, used_mb, total_mb)`` about every ``seconds``, and keeps the peaks."""

    def __init__(self, report: Callable[[float, int, int], None] | None = None, seconds: float = 1.0, proc: str = "/proc"):
        self.report, self.seconds, self.proc = report, seconds, Path(proc)
        self.peak_cpu, self.peak_mb = 0.0, 0
        self._done, self._thread = threading.Event(), threading.Thread(target=self._watch, daemon=True)

    def _times(self) -> tuple[int, int]:
        """Processor ticks so far: (busy, all)."""
        ticks = [int(x) for x in (self.proc / "stat").read_text().split("\n", 1)[0].split()[1:9]]
        return sum(ticks) - ticks[3] - ticks[4], sum(ticks)

    def memory(self) -> tuple[int, int]:
        """(used, total) in MB."""
        got = dict(line.split(":", 1) for line in (self.proc / "meminfo").read_text().splitlines())
        total, free = (int(got[k].split()[0]) // 1024 for k in ("MemTotal", "MemAvailable"))
        return total - free, total

    def _watch(self) -> None:
        try:
            busy, everything = self._times()
            while not self._done.wait(self.seconds):
                now_busy, now = self._times()
                cpu = 100 * (now_busy - busy) / max(1, now - everything)
                busy, everything = now_busy, now
                used, total = self.memory()
                self.peak_cpu, self.peak_mb = max(self.peak_cpu, cpu), max(self.peak_mb, used)
                if self.report:
                    self.report(cpu, used, total)
        except (OSError, KeyError, IndexError, ValueError):
            return  # a system without these files is not watched

    def __enter__(self) -> SystemMonitor:
        self._thread.start()
        return self

    def __exit__(self, *_) -> None:
        self._done.set()
        self._thread.join()
