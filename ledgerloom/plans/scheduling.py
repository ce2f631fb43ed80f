"""Driver-side rules of refreshing: when to ask, when to wait, what a failure costs."""

from __future__ import annotations

from dataclasses import dataclass, replace

#: Fixed values, in seconds: waits after repeated failures and after rate limits, each with its cap; scan and price intervals.
LIMIT_LADDER, LIMIT_CAP = (60, 120, 300), 900
FAILURE_LADDER, FAILURE_CAP = (30, 60, 120), 300
SCAN_INTERVAL, HTTP_TIMEOUT = 300, 15


def backoff(failures: int, limited: bool = False, retry_after: int | None = None) -> int:
    """Seconds to wait after so many failures; the server's own wait after a rate limit wins, up to the cap."""
    ladder, cap = (LIMIT_LADDER, LIMIT_CAP) if limited else (FAILURE_LADDER, FAILURE_CAP)
    if failures <= 0:
        return 0
    if limited and retry_after is not None and retry_after > 0:
        return min(cap, retry_after)
    return min(cap, ladder[min(failures, len(ladder)) - 1])


def jittered(base: int, salt: int, ratio: float = 0.1) -> int:
    """An interval moved by up to the ratio either way, the same for the same salt."""
    spread = int(base * ratio)
    return base if spread == 0 else max(1, base + salt % (2 * spread + 1) - spread)


def retry_after_seconds(header: str | None) -> int | None:
    """Only whole seconds are understood."""
    return int(header) if header is not None and header.strip().isdigit() else None


@dataclass(frozen=True)
class RefreshState:
    running: bool = False
    last_success: float | None = None
    blocked_until: float = 0.0
    failures: int = 0
    identity: str | None = None
    snapshot: dict | None = None


def decide(state: RefreshState, now: float, manual: bool = True, throttle: float = 60.0) -> str:
    """merge into the running refresh, block while waiting (manual or not), throttle a manual one that comes too soon, or begin."""
    if state.running:
        return "merge"
    if now < state.blocked_until:
        return "block"
    if manual and state.last_success is not None and now - state.last_success < throttle:
        return "throttle"
    return "begin"


def begin(state: RefreshState) -> RefreshState:
    return replace(state, running=True)


def apply(state: RefreshState, now: float, outcome: str, snapshot: dict | None = None, identity: str | None = None, retry_after: int | None = None) -> RefreshState:
    """The state after a refresh; another known identity discards the snapshot, an unknown one never does."""
    changed = identity is not None and state.identity is not None and identity != state.identity
    kept = None if changed else state.snapshot
    known = identity or state.identity
    if outcome == "ok":
        return replace(state, running=False, last_success=now, blocked_until=0.0, failures=0, identity=known, snapshot=snapshot)
    failures = state.failures + 1
    wait = backoff(failures, outcome == "rate_limited", retry_after)
    return replace(state, running=False, blocked_until=now + wait, failures=failures, identity=known, snapshot=kept)


def is_stale(state: RefreshState, now: float, interval: float) -> bool:
    return state.last_success is not None and now - state.last_success > 2 * interval
