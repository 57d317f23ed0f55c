"""Side inputs of a run, read by the driver: the configuration (TOML) and the résumé (JSON). Both are small."""

from __future__ import annotations

import json
import math
import os
import re
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from ..operators.triage import Config

# The keys of the file.
_PATHS = ("resume_path", "cover_letter_path", "log_file")
_PLAIN = ("compensation_floor", "compensation_ceiling", "compensation_plausibility_multiplier", "remote_only", "reject_location_only", "blacklist", "aliases", "scoring_weights", "target_companies", "ideological_red_lines", "log_level", "telemetry", "sources")
_WEIGHTS = ("level", "skills", "compensation", "remote")
_SOURCE = ("enabled", "api_key", "posted_at_max_age_days", "strict_filtering", "max_credits_per_run", "query")
#: Keys of a paid feed's query that the feed sets itself, always or with strict filtering.
RESERVED = ("limit", "page", "cursor", "posted_at_max_age_days", "discovered_at_gte", "company_name_not", "company_domain_not")
RESERVED_STRICT = ("workplace_types_or", "min_salary_usd")


@dataclass(frozen=True)
class Settings:
    triage: Config = field(default_factory=Config)
    resume: dict | None = None
    cover_letter: Path | None = None
    sources: dict[str, dict] = field(default_factory=dict)

    def chosen(self, name: str | None = None) -> list[str]:
        """The source named, else all enabled ones in order of their names."""
        if name is None:
            return sorted(k for k, v in self.sources.items() if v.get("enabled", False))
        if name not in self.sources:
            raise ValueError(f"no such source: {name}")
        return [name]


def _filled(x):
    """x with ${NAME} in its strings replaced by the environment's value, or by nothing."""
    if isinstance(x, str):
        return re.sub(r"\$\{([A-Za-z_][A-Za-z0-9_]*)\}", lambda m: os.environ.get(m[1], ""), x)
    if isinstance(x, list):
        return [_filled(v) for v in x]
    return {k: _filled(v) for k, v in x.items()} if isinstance(x, dict) else x


def _known(given: dict, allowed: tuple, where: str) -> None:
    if unknown := sorted(set(given) - set(allowed)):
        raise ValueError(f"{where}: unknown keys: {', '.join(unknown)}")


def load(path: str | Path, required: bool = False) -> Settings:
    """A missing file gives the defaults, unless it is required."""
    path = Path(path)
    if not path.exists():
        if required:
            raise FileNotFoundError(path)
        return Settings()
    raw = _filled(tomllib.loads(path.read_text()))
    _known(raw, _PLAIN + _PATHS, str(path))
    weights = dict.fromkeys(_WEIGHTS, 1.0) | raw.get("scoring_weights", {})
    _known(weights, _WEIGHTS, "scoring_weights")
    for k, w in weights.items():
        if not math.isfinite(w) or w < 0:
            raise ValueError(f"weight {k} must be finite and not below zero: {w}")
    times = raw.get("compensation_plausibility_multiplier")
    times = None if times in (None, "") else float(times)
    if times is not None and not (math.isfinite(times) and times >= 1):
        raise ValueError(f"plausibility multiplier must be finite and at least 1: {times}")
    floor, ceiling = raw.get("compensation_floor"), raw.get("compensation_ceiling")
    if floor is not None and ceiling is not None and ceiling <= floor:
        raise ValueError(f"ceiling {ceiling} must lie above floor {floor}")
    for name, source in raw.get("sources", {}).items():
        _known(source, _SOURCE, f"source {name}")
    home = lambda k: Path(raw[k]).expanduser() if raw.get(k) else None
    resume = read_resume(home("resume_path"))
    triage = Config(
        floor=floor, ceiling=ceiling, multiplier=times, remote_only=raw.get("remote_only", False), reject_location_only=raw.get("reject_location_only", False), blacklist=tuple(raw.get("blacklist", ())),
        red_lines=tuple(raw.get("ideological_red_lines", ())), skills=None if resume is None else tuple(keywords(resume)), aliases=raw.get("aliases", {}), weights=weights,
    )
    return Settings(triage, resume, home("cover_letter_path"), raw.get("sources", {}))


def read_resume(path: Path | None) -> dict | None:
    """None if none is configured; one that is configured must be there and be JSON."""
    return None if path is None else json.loads(path.read_text())


def keywords(resume: dict) -> list[str]:
    """Keywords of all skills, each once whatever its case; the first form stays."""
    seen: dict[str, str] = {}
    for skill in resume.get("skills") or []:
        for k in skill.get("keywords") or []:
            seen.setdefault(k.lower(), k)
    return list(seen.values())


def paid_query(settings: Settings, name: str, watermark: str | None = None, page: int = 500) -> dict:
    """The request of a paid feed: the blacklist by domain or name, strict filters, the watermark, then the user's own keys."""
    source, t = settings.sources[name], settings.triage
    strict, own = source.get("strict_filtering", False), source.get("query") or {}
    if taken := sorted(set(own) & set(RESERVED + (RESERVED_STRICT if strict else ()))):
        raise ValueError(f"source {name}: reserved keys: {', '.join(taken)}")
    domain = lambda e: "." in e and not re.search(r"\s", e)
    out = {"posted_at_max_age_days": source.get("posted_at_max_age_days", 30), "limit": page, "company_domain_not": [e for e in t.blacklist if domain(e)], "company_name_not": [e for e in t.blacklist if not domain(e)]}
    if strict and t.remote_only:
        out["workplace_types_or"] = ["remote"]
    if strict and t.floor is not None:
        out["min_salary_usd"] = t.floor
    if watermark is not None:
        out["discovered_at_gte"] = watermark
    return {k: v for k, v in out.items() if v != []} | own
