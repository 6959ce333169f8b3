"""A lease that only one run holds, with a number that tells its writers from later ones.

Each holder creates the next numbered file.  A lease ends when it is released or
has not been renewed for ``ttl_s``.  A holder that was gone for too long may wake
and go on, but its number is no longer the highest: ``check`` refuses it, and so
does every table that has seen a higher number.  Releasing a lease touches nothing
but its own number, so a successor keeps what it holds.
"""

from __future__ import annotations

import contextlib
import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession

from millrace.sources.files import Folder


class LeaseLost(RuntimeError):
    """The lease is held by somebody else, or has ended."""


@dataclass
class Lease:
    folder: Folder
    number: int
    ttl_s: float

    def check(self) -> int:
        """The number, as long as nobody holds a higher one."""
        if _highest(self.folder) != self.number:
            raise LeaseLost(f"lease {self.number} of {self.folder.path} was taken over")
        return self.number

    def renew(self) -> None:
        self.check()
        self.folder.create(f"{self.number:012d}.renewed-{time.time_ns()}", "")

    def release(self) -> None:
        self.folder.create(f"{self.number:012d}.released", "")


def _numbers(folder: Folder) -> dict[int, list[str]]:
    out: dict[int, list[str]] = {}
    for name in folder.names():
        if name[:12].isdigit():
            out.setdefault(int(name[:12]), []).append(name)
    return out


def _highest(folder: Folder) -> int:
    return max(_numbers(folder), default=0)


def acquire(spark: SparkSession, path: str, ttl_s: float = 3600, now: float | None = None) -> Lease:
    """The lease at ``path``; ``LeaseLost`` where a run holds it that has neither ended nor been silent for ``ttl_s``."""
    folder = Folder(spark, path)
    numbers = _numbers(folder)
    last = max(numbers, default=0)
    if last and f"{last:012d}.released" not in numbers[last]:
        seen = max(folder.modified(name) for name in numbers[last])
        if (time.time() if now is None else now) - seen < ttl_s:
            raise LeaseLost(f"another run holds {path}")
    if not folder.create(f"{last + 1:012d}", ""):
        raise LeaseLost(f"another run has just taken {path}")
    for number in sorted(numbers)[:-1]:
        for name in numbers[number]:
            folder.delete(name)
    return Lease(folder, last + 1, ttl_s)


@contextlib.contextmanager
def held(spark: SparkSession, path: str, ttl_s: float = 3600) -> Iterator[Lease]:
    lease = acquire(spark, path, ttl_s)
    try:
        yield lease
    finally:
        lease.release()
