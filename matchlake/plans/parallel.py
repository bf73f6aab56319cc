"""Independent pieces of a report whose plans start jobs of their own, run side by side."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor


def together(fn: Callable, items: Iterable, at_once: int = 4) -> list:
    """``[fn(x) for x in items]`` with up to ``at_once`` calls at a time; small jobs then share the
    cluster instead of waiting for each other. The first error is raised."""
    items = list(items)
    if len(items) < 2:
        return [fn(x) for x in items]
    with ThreadPoolExecutor(min(at_once, len(items))) as pool:
        return list(pool.map(fn, items))
