"""A remote embedding provider made dependable: batches, bounded concurrency, retries with growing pauses, results in order.

``call`` sends one batch and gives (index, vector) pairs in any order, or raises; what it speaks to is the caller's. The result
is a provider as ``refine.embedded`` takes it, so it runs inside tasks, each with its own few connections.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

Pairs = list[tuple[int, list[float]]]


class ProviderError(RuntimeError):
    """The provider failed on a batch as often as it may, or answered with other vectors than were asked for."""


def _one(call: Callable[[list[str]], Pairs], texts: list[str], dim: int, retries: int, pause: float, sleep: Callable[[float], None]) -> list[list[float]]:
    for attempt in range(retries + 1):
        try:
            pairs = call(texts)
            break
        except Exception as error:  # noqa: BLE001
            if attempt == retries:
                raise ProviderError(f"failed {retries + 1} times: {error}") from error
            sleep(pause * 2**attempt)
    if sorted(i for i, _ in pairs) != list(range(len(texts))):
        raise ProviderError(f"{len(pairs)} vectors for {len(texts)} texts, or indexes that repeat")
    rows = [v for _, v in sorted(pairs, key=lambda p: p[0])]
    if any(len(v) != dim for v in rows):
        raise ProviderError(f"a vector of another length than {dim}")
    return rows


def dependable(
    call: Callable[[list[str]], Pairs], dim: int, batch: int = 8, concurrency: int = 4, retries: int = 3, pause: float = 1.0, sleep: Callable[[float], None] = time.sleep
) -> Callable[[list[str]], list[list[float]]]:
    """A provider over ``call``: at most ``concurrency`` batches of ``batch`` texts at once; no texts give no call.

    The first failed batch fails the whole, and batches not yet begun are given up.
    """
    if min(batch, concurrency) < 1 or retries < 0:
        raise ValueError("batch and concurrency must be 1 or more, retries 0 or more")

    def provider(texts: list[str]) -> list[list[float]]:
        parts = [texts[i : i + batch] for i in range(0, len(texts), batch)]
        with ThreadPoolExecutor(max_workers=concurrency) as pool:
            jobs = [pool.submit(_one, call, part, dim, retries, pause, sleep) for part in parts]
            try:
                return [row for job in jobs for row in job.result()]
            except ProviderError:
                for job in jobs:
                    job.cancel()
                raise

    return provider
