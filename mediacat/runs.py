"""A run over all bucket pairs of a configuration: lock, budget, passes, cleanup, counters.

The caller brings what touches the outside world as callables of a pair: its listing, its
store, and how contents are read, probed and encoded. A pair is skipped while another run holds
its destination's lock. A listing that ends with an error counts as one failure, ends the run
and is not cleaned up after; nor is a destination that another pair writes to under an
overlapping prefix, where that pair's objects would look like orphans.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from mediacat import locking
from mediacat.config import Bucket, Config, normal_endpoint
from mediacat.operators import gates, state
from mediacat.pipeline import Pass
from mediacat.sources import listing

Pair = tuple[Bucket, Bucket]


class Shared(RuntimeError):
    """A destination that several pairs write to."""


@dataclass
class Media:
    """How the contents of a pair's sources are handled, see `Pass.videos` and `Pass.images`."""

    content: Callable[[DataFrame], DataFrame]
    probe: Callable[[DataFrame], DataFrame]
    encode: Callable[[DataFrame], DataFrame]
    hasher: Callable[[DataFrame], DataFrame] | None = None


def sharing(pairs: list[Pair], at: int) -> list[int]:
    """Other pairs whose destination is the same bucket and whose sources' keys may begin alike."""
    source, dest = pairs[at]
    same = lambda d: (normal_endpoint(d.endpoint), d.bucket, d.prefix) == (normal_endpoint(dest.endpoint), dest.bucket, dest.prefix)
    meet = lambda s: s.prefix.startswith(source.prefix) or source.prefix.startswith(s.prefix)
    return [i for i, (s, d) in enumerate(pairs) if i != at and same(d) and meet(s)]


def _empty() -> dict[str, int]:
    return {**dict.fromkeys(gates.OUTCOMES, 0), "total": 0}


def run(
    config: Config,
    listed: Callable[[Pair], DataFrame],
    store: Callable[[Pair], state.TableStore],
    media: Callable[[Pair], Media],
    at: str,
    version: str,
    files: Callable[[Pair], locking.Files] | None = None,
    stopped: Callable[[], bool] = lambda: False,
    clock: Callable[[], float] = time.monotonic,
    slice_size: int | None = None,
) -> dict:
    """Counters by outcome, durationMs, pairsProcessed, totalPairs, and under `pairs` each pair's.

    No pair is begun after the budget or once `stopped`; a run that is stopped before its first
    pair has counters of zero. With `slice_size` a pair's videos are taken by so many at a time, none
    are begun after the budget or once stopped either, and the next run goes on from there; a pair
    left open (`open`) is not cleaned up. Cleanup follows a pair's passes where the configuration asks for it.
    """
    began, each, total = clock(), {}, _empty()
    for i, pair in enumerate(config.pairs):
        if stopped() or clock() - began > config.budget:
            break
        lock = locking.acquire_on(files(pair), config.lock_ttl, config.max_runtime, config.platform) if files else None
        if files and lock is None:
            continue
        try:
            each[i] = _pair(config, i, listed(pair), store(pair), media(pair), at, version, slice_size, lambda: not stopped() and clock() - began <= config.budget)
        finally:
            if lock:
                lock.release()
        for k, v in each[i].items():
            if isinstance(v, int):
                total[k] = total.get(k, 0) + v
        if each[i].get("error") or each[i].get("open"):
            break
    return {**total, "durationMs": int((clock() - began) * 1000), "pairsProcessed": len(each), "totalPairs": len(config.pairs), "pairs": each}


def _pair(config: Config, i: int, objects: DataFrame, store: state.TableStore, media: Media, at: str, version: str, slice_size: int | None = None, go_on: Callable[[], bool] = lambda: True) -> dict:
    own = Pass(store, at, version, config.pairs[i][0].prefix, config.max_attempts if config.tombstones else 1 << 30, threshold=config.threshold, perceptual_dry_run=config.dry_run, ladder=config.ladder)
    try:
        objects = listing.whole(objects)
    except listing.Incomplete as e:
        return {**_empty(), "failed": 1, "total": 1, "error": str(e)}
    if slice_size:
        out, whole = own.videos_by_slices(objects, media.content, media.probe, media.encode, slice_size, go_on)
        if not whole:
            return {**out, "open": "budget: the next run goes on"}
    else:
        out = own.videos(objects, media.content, media.probe, media.encode)
    if media.hasher:
        for k, v in replace(own).images(objects, media.hasher).items():
            out[k] = out.get(k, 0) + v
    if config.cleanup:
        if others := sharing(config.pairs, i):
            out["refused"] = f"cleanup: pairs {others} write to the same destination"
        else:
            out["cleaned"] = own.clean(objects)[0]["orphan_mappings"]
    return out
