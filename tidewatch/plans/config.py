"""Configuration: defaults, then a TOML file, then environment variables TIDEWATCH_<SECTION>_<NAME>, then arguments."""

from __future__ import annotations

import math
import os
import tomllib
from copy import deepcopy

#: The defaults by section.
DEFAULTS: dict[str, dict] = {
    "ingest": {"window_size_s": 60, "max_emit_latency_s": 600, "poll_interval_ms": 1000, "read_chunk_bytes": 262_144, "follow_symlinks": False, "max_line_len": 16_384},
    "features": {"dict_enabled": True, "dict_max_entries": 2_000_000},
    "baseline": {"baseline_days": 7, "df_bucket_count": 48, "df_ring_slots": 7},
    "scoring": {"outlier_threshold": 0.85, "noise_threshold": 0.65, "cold_start_days": 2, "min_lines_per_window": 10},
    "caps": {"max_features_per_window": 50_000, "max_word_features_per_window": 20_000, "max_shape_features_per_window": 20_000, "max_syslog_features_per_window": 2_000, "max_srcips": 64, "max_dstips": 64, "max_userids": 128, "max_domains": 128, "max_hosts": 128},
    "output": {"sink": "jsonl", "jsonl_rotate_mb": 256, "include_debug_fields": False, "replay_max_files": 128, "spool_max_mb": 2048},
    "vdrop": {"enabled": True, "device_enabled": True, "tenant_enabled": True, "source_stream_enabled": False, "min_expected_windows_missed": 3, "min_mature_windows": None, "min_expected_lines": None},
}
WINDOW_SIZES = (60, 120, 300, 600)
SINKS = ("jsonl", "stdout")


class ConfigError(ValueError):
    pass


def _typed(text: str, like):
    if isinstance(like, bool):
        if text.lower() not in ("true", "false", "1", "0"):
            raise ConfigError(f"not a switch: {text!r}")
        return text.lower() in ("true", "1")
    if isinstance(like, float):
        return float(text)
    return text if isinstance(like, str) else int(text)


def load(path: str | None = None, environ: dict[str, str] | None = None, **given) -> dict[str, dict]:
    """given: section_name=value."""
    cfg = deepcopy(DEFAULTS)
    if path:
        try:
            with open(path, "rb") as f:
                read = tomllib.load(f)
        except (OSError, tomllib.TOMLDecodeError) as e:
            raise ConfigError(f"{path}: {e}") from e
        for section, values in read.items():
            for name, value in values.items():
                if name not in cfg.get(section, {}):
                    raise ConfigError(f"unknown setting {section}.{name}")
                cfg[section][name] = value
    environ = os.environ if environ is None else environ
    for section, values in cfg.items():
        for name, value in values.items():
            try:
                if (text := environ.get(f"TIDEWATCH_{section}_{name}".upper())) is not None:
                    values[name] = _typed(text, DEFAULTS[section][name])
            except ValueError as e:
                raise ConfigError(str(e)) from e
            if f"{section}_{name}" in given:
                values[name] = given[f"{section}_{name}"]
    return validate(cfg)


def validate(cfg: dict[str, dict], any_size: bool = False) -> dict[str, dict]:
    size, s = cfg["ingest"]["window_size_s"], cfg["scoring"]
    tests = [
        (any_size or size in WINDOW_SIZES, "ingest.window_size_s"),
        (cfg["ingest"]["max_emit_latency_s"] >= size, "ingest.max_emit_latency_s"),
        (0 < cfg["ingest"]["read_chunk_bytes"], "ingest.read_chunk_bytes"),
        (0 < cfg["ingest"]["max_line_len"], "ingest.max_line_len"),
        *[(math.isfinite(s[n]) and 0 <= s[n] <= 1, f"scoring.{n}") for n in ("outlier_threshold", "noise_threshold")],
        *[(v > 0, f"caps.{n}") for n, v in cfg["caps"].items()],
        (cfg["output"]["sink"] in SINKS, "output.sink"),
        (cfg["vdrop"]["min_expected_windows_missed"] > 0, "vdrop.min_expected_windows_missed"),
    ]
    if bad := [name for ok, name in tests if not ok]:
        raise ConfigError(f"invalid: {', '.join(bad)}")
    return cfg


#: What a tenant's policy may say.
POLICY = {"policy_version", "key_overrides", "ip_bucket", "min_identity_confidence", "vdrop_enabled", "vdrop_device_enabled", "vdrop_tenant_enabled", "vdrop_source_stream_enabled", "vdrop_min_expected_windows_missed", "vdrop_min_mature_windows", "vdrop_min_expected_lines"}


def load_policy(path: str) -> dict:
    import ipaddress

    try:
        with open(path, "rb") as f:
            got = tomllib.load(f)
    except (OSError, tomllib.TOMLDecodeError) as e:
        raise ConfigError(f"{path}: {e}") from e
    bad = [f"unknown {k}" for k in got if k not in POLICY]
    if got.get("policy_version") != 1:
        bad.append("policy_version must be 1")
    if "ip_bucket" in got:
        try:
            ipaddress.ip_network(got["ip_bucket"], strict=False)
        except ValueError as e:
            bad.append(f"ip_bucket: {e}")
    if got.get("vdrop_min_expected_windows_missed") == 0:
        bad.append("vdrop_min_expected_windows_missed is 0")
    bad += [f"key_overrides.{k}" for k in got.get("key_overrides", {}) if not k.strip()]
    if bad:
        raise ConfigError("; ".join(bad))
    return {"min_identity_confidence": 2, "key_overrides": {}} | got


def silence_gates(cfg: dict[str, dict], policy: dict | None = None):
    """Tenant override, else configuration, else what scoring implies."""
    from ..operators.volume_loss import SilenceGates

    policy, v, s = policy or {}, cfg["vdrop"], cfg["scoring"]
    pick = lambda *xs: next(x for x in xs if x is not None)
    mature = s["cold_start_days"] * (3600 // cfg["ingest"]["window_size_s"])
    return SilenceGates(pick(policy.get("vdrop_min_mature_windows"), v["min_mature_windows"], mature), pick(policy.get("vdrop_min_expected_windows_missed"), v["min_expected_windows_missed"]), pick(policy.get("vdrop_min_expected_lines"), v["min_expected_lines"], s["min_lines_per_window"]))


def volume(cfg: dict[str, dict], policy: dict | None = None):
    """What is watched for lost volume, or None where [vdrop] is off."""
    from ..operators.volume_loss import Volume

    policy, v = policy or {}, cfg["vdrop"]
    on = lambda name: policy.get(f"vdrop_{name}", v[name])
    return Volume(on("device_enabled"), on("tenant_enabled"), streams_enabled(cfg, policy), silence_gates(cfg, policy)) if on("enabled") else None


def caps(cfg: dict[str, dict]) -> tuple[dict[str, int], dict[str, int]]:
    """(caps of a row's features by class, of its entities by kind)."""
    c = cfg["caps"]
    classes = {n: c[f"max_{n.lower()}_features_per_window"] for n in ("Word", "Shape", "Syslog")} | {"all": c["max_features_per_window"]}
    return classes, {"SourceIp": c["max_srcips"], "DestIp": c["max_dstips"], "UserId": c["max_userids"], "Domain": c["max_domains"], "Host": c["max_hosts"]}


def streams_enabled(cfg: dict[str, dict], policy: dict | None = None) -> bool:
    policy = policy or {}
    return policy.get("vdrop_enabled", cfg["vdrop"]["enabled"]) and policy.get("vdrop_source_stream_enabled", cfg["vdrop"]["source_stream_enabled"])
