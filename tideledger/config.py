"""Settings of the operators: one frozen value, from defaults, a properties file, and the environment."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace
from decimal import Decimal
from pathlib import Path

ENV_PREFIX = "TIDELEDGER_"
HOUR_MS = 3_600_000
DAY_MS = 24 * HOUR_MS


@dataclass(frozen=True)
class Settings:
    """Thresholds in milliseconds unless named otherwise; fixed values of the rules. Secrets come from the environment only."""

    zone: str = "Asia/Shanghai"
    deduct_refunds: bool = True
    abandon_after_ms: int = 30 * 60_000
    repeat_window_ms: int = HOUR_MS
    repeat_count: int = 3
    dedup_ttl_ms: int = 2 * DAY_MS
    same_rule_ms: int = 7 * DAY_MS
    same_sku_ms: int = 30 * DAY_MS
    daily_pushes: int = 3
    risk_window_ms: int = 7 * DAY_MS
    risk_count: int = 5
    unpaid_timeout_ms: int = 60_000
    watermark_ms: int = 120_000
    output_every_ms: int = 5_000
    order_state_ttl_ms: int = 30 * DAY_MS
    cart_ttl_ms: int = 2 * HOUR_MS
    push_ttl_ms: int = 30 * DAY_MS
    day_state_ttl_ms: int = 2 * DAY_MS
    pending_ttl_ms: int = DAY_MS
    starting_offsets: str = "committed"
    servers: str = "localhost:9092"
    message_dir: str = ""
    table_dir: str = ""
    checkpoint_dir: str = ""


@dataclass(frozen=True)
class Credentials:
    """A user and a password, given by the environment only and never shown."""

    user: str
    password: str = field(repr=False)

    @classmethod
    def of(cls, store: str, environ: Mapping[str, str] | None = None) -> Credentials:
        """TIDELEDGER_<STORE>_USER and TIDELEDGER_<STORE>_PASSWORD; a blank one is missing."""
        given = os.environ if environ is None else environ
        return cls(required(given, f"{ENV_PREFIX}{store.upper()}_USER"), required(given, f"{ENV_PREFIX}{store.upper()}_PASSWORD"))


def required(values: Mapping[str, str], key: str) -> str:
    """A value that must be there; a blank one is missing."""
    value = values.get(key, "").strip()
    if not value:
        raise KeyError(f"setting {key} is missing")
    return value


def read_properties(text: str) -> dict[str, str]:
    """key=value lines; # and ! start comments."""
    found = {}
    for line in text.splitlines():
        line = line.strip()
        if line and line[0] not in "#!" and "=" in line:
            key, _, value = line.partition("=")
            found[key.strip()] = value.strip()
    return found


def _typed(value: str, like: object) -> object:
    if isinstance(like, bool):
        if value.lower() not in ("true", "false"):
            raise ValueError(f"not a truth value: {value}")
        return value.lower() == "true"
    return type(like)(value) if isinstance(like, (int, Decimal)) else value


def load_settings(*layers: Mapping[str, str], environ: Mapping[str, str] | None = None) -> Settings:
    """Defaults, overlaid by each layer in turn and last by TIDELEDGER_* of the environment; blank values count as missing."""
    environ = os.environ if environ is None else environ
    named = {f.name: environ[ENV_PREFIX + f.name.upper()] for f in fields(Settings) if ENV_PREFIX + f.name.upper() in environ}
    settings = Settings()
    for layer in (*layers, named):
        given = {k: v.strip() for k, v in layer.items() if k in {f.name for f in fields(Settings)} and v.strip()}
        settings = replace(settings, **{k: _typed(v, getattr(Settings, k)) for k, v in given.items()})
    return settings


def load_profile(profile: str, folder: str, overlay: str | None = None, environ: Mapping[str, str] | None = None) -> Settings:
    """Settings of a profile: `settings.properties` of the folder if there, `settings-<profile>.properties`, the overlay file, the environment; later ones win.

    A profile's file must exist; a password in a file is an error, since secrets belong to the environment.
    """
    layers = []
    base, own = Path(folder) / "settings.properties", Path(folder) / f"settings-{profile}.properties"
    if not own.is_file():
        raise FileNotFoundError(own)
    for path in (base, own, *([Path(overlay)] if overlay else [])):
        if path == base and not path.is_file():
            continue
        values = read_properties(path.read_text())
        if secret := [k for k in values if "password" in k.lower()]:
            raise ValueError(f"{path} holds a secret: {', '.join(sorted(secret))}")
        layers.append(values)
    return load_settings(*layers, environ=environ)
