"""Run configuration: bucket pairs, credentials, ladder, budgets, log level."""

from __future__ import annotations

import json
import math
from collections.abc import Mapping
from dataclasses import dataclass, field
from urllib.parse import urlsplit

from mediacat.functions.media import LADDER, RUNG

# Longest run of each platform in seconds, and its log levels by rank.
RUNTIME = {"aws-lambda": 900.0, "cloudflare-container": 3600.0, "local": 3600.0}
LEVELS = ("debug", "info", "warn", "error")
POLL_SECONDS = 900.0


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class Bucket:
    bucket: str
    endpoint: str
    access_key_id: str
    secret_access_key: str
    region: str = "auto"
    prefix: str = ""


@dataclass(frozen=True)
class Config:
    pairs: list[tuple[Bucket, Bucket]]
    platform: str = "local"
    max_runtime: float = 3600.0
    lock_ttl: int = 5400
    budget: int = 2700
    threshold: float = 0.95
    dry_run: bool = False
    cleanup: bool = False
    tombstones: bool = True
    max_attempts: int = 3
    poll_seconds: float = 0.0
    ladder: tuple = field(default=LADDER)
    log_level: str = "info"
    #: Read for compatibility; the cluster's own parallelism takes its place.
    max_concurrency: int = 1


def normal_endpoint(url: str) -> str:
    """Scheme and host in lower case, default ports dropped; the lower-case input where it has no host."""
    try:
        parts = urlsplit(url)
        host = parts.netloc.lower()
    except ValueError:
        return url.lower()
    if not parts.scheme or not host:
        return url.lower()
    port = {"https": ":443", "http": ":80"}.get(parts.scheme.lower(), "\0")
    return f"{parts.scheme.lower()}://{host.removesuffix(port)}"


def overlap(a: Bucket, b: Bucket) -> bool:
    """Same endpoint and bucket, and one prefix begins with the other."""
    return normal_endpoint(a.endpoint) == normal_endpoint(b.endpoint) and a.bucket == b.bucket and (a.prefix.startswith(b.prefix) or b.prefix.startswith(a.prefix))


def check_disjoint(pairs: list[tuple[Bucket, Bucket]]) -> None:
    if not pairs:
        raise ConfigError("at least one bucket pair is needed")
    for i, (source, _) in enumerate(pairs):
        for j, (_, dest) in enumerate(pairs):
            if overlap(source, dest):
                raise ConfigError(f"source {i} ({source.bucket}/{source.prefix}) overlaps with destination {j} ({dest.bucket}/{dest.prefix})")


def lock_ttl(runtime: float, factor: float = 1.5) -> int:
    return math.ceil(runtime * factor)


def time_budget(runtime: float, factor: float = 0.75) -> int:
    return math.floor(runtime * factor)


def _bucket(own: Mapping, pair: Mapping, env: Mapping, side: str, at: int) -> Bucket:
    pick = lambda name, *more: next((v for v in (own.get(name), pair.get(name), *more) if v), "")
    for name in ("bucket", "endpoint"):
        if not own.get(name):
            raise ConfigError(f"pairs[{at}].{side}.{name} is required")
    key, secret = (pick(n, env.get(f"{side.upper()}_{e}")) for n, e in (("accessKeyId", "ACCESS_KEY_ID"), ("secretAccessKey", "SECRET_ACCESS_KEY")))
    if not key or not secret:
        raise ConfigError(f"pairs[{at}].{side} has no credentials")
    return Bucket(own["bucket"], own["endpoint"], key, secret, pick("region", env.get(f"{side.upper()}_REGION"), "auto"), own.get("prefix") or "")


def parse_pairs(text: str, env: Mapping) -> list[tuple[Bucket, Bucket]]:
    try:
        rows = json.loads(text)
    except ValueError as e:
        raise ConfigError(f"bucket pairs are not JSON: {e}") from e
    if not isinstance(rows, list) or not rows:
        raise ConfigError("bucket pairs must be a non-empty array")
    out = []
    for i, row in enumerate(rows):
        if not isinstance(row, dict) or not row.get("source") or not row.get("dest"):
            raise ConfigError(f"pairs[{i}] needs source and dest")
        out.append((_bucket(row["source"], row, env, "source", i), _bucket(row["dest"], row, env, "dest", i)))
    return out


def _pair_from_env(env: Mapping) -> tuple[Bucket, Bucket]:
    side = lambda s: {"bucket": env.get(f"{s}_BUCKET"), "endpoint": env.get(f"{s}_ENDPOINT"), "prefix": env.get(f"{s}_PREFIX")}
    return _bucket(side("SOURCE"), {}, env, "source", 0), _bucket(side("DEST"), {}, env, "dest", 0)


def parse_ladder(text: str) -> tuple:
    """Rungs of a JSON array; numbers must be positive."""
    rows = json.loads(text)
    names = ("name", "width", "height", "videoBitrateKbps", "audioBitrateKbps")
    if not isinstance(rows, list) or not rows:
        raise ConfigError("the ladder must be a non-empty array")
    out = []
    for row in rows:
        rung = tuple(row.get(n) for n in names)
        if not rung[0] or any(not isinstance(v, int) or v <= 0 for v in rung[1:]):
            raise ConfigError(f"a rung needs {', '.join(RUNG)}, all positive: {row}")
        out.append(rung)
    return tuple(out)


def _number(env: Mapping, name: str, default: float) -> float:
    text = env.get(name) or ""
    if not text:
        return default
    try:
        value = float(text)
    except ValueError as e:
        raise ConfigError(f"{name} is not a number: {text}") from e
    if not math.isfinite(value):
        raise ConfigError(f"{name} is not finite: {text}")
    return value


def load(env: Mapping[str, str], platform: str = "local") -> Config:
    """Settings from the environment; pairs come from a file, else a JSON literal, else single variables."""
    if path := env.get("BUCKETS_CONFIG_FILE"):
        with open(path) as f:
            pairs = parse_pairs(f.read(), env)
    elif text := env.get("BUCKETS_CONFIG"):
        pairs = parse_pairs(text, env)
    else:
        pairs = [_pair_from_env(env)]
    check_disjoint(pairs)
    level = (env.get("LOG_LEVEL") or "info").lower()
    if level not in LEVELS:
        raise ConfigError(f"unknown log level: {level}")
    runtime = _number(env, "MAX_RUNTIME_SECONDS", RUNTIME[platform])
    flag = lambda name, default: (env.get(name) or default).lower() == "true"
    return Config(
        pairs, platform, runtime, lock_ttl(runtime, _number(env, "LOCK_TTL_MULTIPLIER", 1.5)), time_budget(runtime, _number(env, "RUNTIME_BUDGET_MULTIPLIER", 0.75)), _number(env, "PERCEPTUAL_THRESHOLD", 0.95),
        flag("PERCEPTUAL_DRY_RUN", "false"), flag("CLEANUP_ENABLED", "false"), (env.get("ERROR_TOMBSTONES") or "true").lower() != "false", int(_number(env, "TOMBSTONE_MAX_ATTEMPTS", 3)),
        _number(env, "POLL_FALLBACK_SECONDS", 0.0), parse_ladder(env["LADDER"]) if env.get("LADDER") else LADDER, level, int(_number(env, "MAX_CONCURRENCY", 1)),
    )
