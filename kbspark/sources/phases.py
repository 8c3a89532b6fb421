"""What may watch the phases of work on a bundle: a scan, a graph."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

_watchers: list[object] = []


@contextmanager
def watching(watcher: object) -> Iterator[None]:
    """Tell watcher of all phases inside: started(phase, bundle), then ended(phase, bundle, result) or failed(phase, bundle, error).

    A watcher may lack any of these. They run on the driver. Results are tables that may not have been computed yet, so what
    is to be known of single concepts is asked of the table, not told one by one.
    """
    _watchers.append(watcher)
    try:
        yield
    finally:
        _watchers.remove(watcher)


def _tell(what: str, *about: object) -> None:
    for watcher in tuple(_watchers):
        if (told := getattr(watcher, what, None)) is not None:
            told(*about)


@contextmanager
def phase(name: str, bundle: object) -> Iterator[list]:
    """A phase; its result is what is appended to the list."""
    _tell("started", name, bundle)
    result: list = []
    try:
        yield result
    except BaseException as e:
        _tell("failed", name, bundle, e)
        raise
    _tell("ended", name, bundle, result[-1] if result else None)
