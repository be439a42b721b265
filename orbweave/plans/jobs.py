"""Driver-side run control: queue of jobs, single-run guard, choice between crawl and update, completion."""

from __future__ import annotations

import threading
from collections import deque
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column
from pyspark.sql import functions as F


class RunningError(RuntimeError):
    """A catalog is already in a run."""


class JobQueue:
    """Pending (catalog id, action) pairs, first in first out."""

    def __init__(self) -> None:
        self._jobs: deque[tuple[int, str]] = deque()

    def put(self, catalog_id: int, action: str) -> None:
        if action not in ("crawl", "rebuild"):
            raise ValueError(f"unknown action: {action}")
        self._jobs.append((catalog_id, action))

    def take(self) -> tuple[int, str] | None:
        return self._jobs.popleft() if self._jobs else None

    def __len__(self) -> int:
        return len(self._jobs)


class RunGuard:
    """One run at a time; callbacks on completion and interruption; a flag that a running loop reads."""

    def __init__(self) -> None:
        self._permit = threading.Semaphore(1)
        self.running: int | None = None
        self._stop = threading.Event()
        self.on_completion: list[Callable[[int], None]] = []
        self.on_interruption: list[Callable[[int | None], None]] = []

    @contextmanager
    def run(self, catalog_id: int, wait_s: float = 3.0):
        if not self._permit.acquire(timeout=wait_s):
            raise RunningError(f"catalog {self.running} is running")
        self.running = catalog_id
        self._stop.clear()
        try:
            yield self
        finally:
            self.running = None
            self._permit.release()
            for call in self.on_completion:
                call(catalog_id)

    def check(self, catalog_id: int) -> None:
        """Reject an operation on the catalog that is in a run."""
        if self.running == catalog_id:
            raise RunningError(f"catalog {catalog_id} is running")

    def interrupt(self) -> None:
        """Ask the run to stop after its level, and tell who listens."""
        self._stop.set()
        for call in self.on_interruption:
            call(self.running)

    def interrupted(self) -> bool:
        return self._stop.is_set()


def decide(latest_path: str | None, url: str, other_running: bool = False) -> str:
    """`enqueue` while another run is on; `update` from a page other than the site's first; else `crawl`."""
    if other_running:
        return "enqueue"
    return "update" if latest_path and latest_path.strip() and latest_path not in (url, url + "/") else "crawl"


def decision(latest_path: Column, url: Column) -> Column:
    """`decide` as a column, for many catalogs at once."""
    again = latest_path.isNotNull() & (F.trim(latest_path) != "") & ~((latest_path == url) | (latest_path == F.concat(url, F.lit("/"))))
    return F.when(F.coalesce(again, F.lit(False)), "update").otherwise("crawl")
