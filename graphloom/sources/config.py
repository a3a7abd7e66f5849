"""Configuration of the engine and of its repositories, with defaults and checks."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

from graphloom.operators import concepts, documents
from graphloom.plans.runner import Pass

#: What counts where a configuration says nothing.
DEFAULTS = {
    "orchestrator": {"enabled": True, "passTimeoutSeconds": 300, "passFailurePolicy": "continue", "passes": {}},
    "enrichment": {"conceptExtraction": {"minDocChars": concepts.MIN_CHARS, "similarityThreshold": concepts.MERGE}, "docGraphCron": {"scheduleMinutes": 0, "fuzzyThreshold": documents.FUZZY}},
    "rateLimits": {"defaults": {"perMinute": 60, "perHour": 500}, "perToken": []},
}
REPO = {"branch": "main", "cloneDepth": 0, "ignorePatterns": []}
NAME, URL = r"[A-Za-z0-9._-]+", r"(git@[^:]+:|ssh://)"


class ConfigError(ValueError):
    """What is wrong with a configuration."""


def _parsed(path: str):
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f)


def merged(defaults: dict, given) -> dict:
    """``defaults`` with what is given in their place, section by section; lists and values as a whole, nulls not at all."""
    out = {k: merged(v, {}) if isinstance(v, dict) else (list(v) if isinstance(v, list) else v) for k, v in defaults.items()}
    for k, v in (given if isinstance(given, dict) else {}).items():
        if v is not None:
            out[k] = merged(out[k], v) if isinstance(out.get(k), dict) else v
    return out


def load(path: str) -> dict:
    """The configuration in a YAML file; a file that is missing or can't be parsed gives the defaults."""
    import yaml

    try:
        return merged(DEFAULTS, _parsed(path))
    except (OSError, UnicodeDecodeError, yaml.YAMLError):
        return merged(DEFAULTS, {})


def configured(passes: list[Pass], config: dict) -> list[Pass]:
    """Passes as the configuration has them: enabled unless it says false, with its policy for failures."""
    known = config["orchestrator"]
    policy = "abort" if known["passFailurePolicy"] == "abort" else "continue"
    wanted = {n: s for n, s in known["passes"].items() if isinstance(s, dict)}
    return [replace(p, enabled=known["enabled"] and (wanted[p.name].get("enabled") is not False if p.name in wanted else p.enabled), on_error=policy) for p in passes]


@dataclass(frozen=True)
class Repo:
    name: str
    url: str
    branch: str
    cloneDepth: int
    ignorePatterns: list[str]
    boundedContexts: list[dict]


def repos(path: str) -> list[Repo] | None:
    """The repositories of a YAML file, checked; None if there is no file."""
    try:
        raw = _parsed(path) or {}
    except OSError:
        return None
    if not isinstance(raw, dict) or not isinstance(raw.get("repos") or [], list):
        raise ConfigError("repos must be a list")
    base, found = _options(raw.get("defaults"), REPO), []
    for entry in raw.get("repos") or []:
        repo = _repo(entry if isinstance(entry, dict) else {}, base)
        if repo.name in {r.name for r in found}:
            raise ConfigError(f"repository {repo.name!r} is there twice")
        found.append(repo)
    return found


def _options(raw, base: dict) -> dict:
    """Branch, depth and ignored patterns as given where they are of their kind, else as in ``base``."""
    raw = raw if isinstance(raw, dict) else {}
    branch, depth, ignored = (raw.get(k) for k in REPO)
    whole = isinstance(depth, int) and not isinstance(depth, bool) and depth >= 0
    return {"branch": branch if isinstance(branch, str) and branch else base["branch"], "cloneDepth": depth if whole else base["cloneDepth"], "ignorePatterns": [s for s in ignored if isinstance(s, str)] if isinstance(ignored, list) else list(base["ignorePatterns"])}


def _repo(raw: dict, base: dict) -> Repo:
    name, url = raw.get("name"), raw.get("url")
    if not isinstance(name, str) or not re.fullmatch(NAME, name) or name in (".", ".."):
        raise ConfigError(f"{name!r} is no name of a repository")
    if not isinstance(url, str) or not re.match(URL, url):
        raise ConfigError(f"repository {name!r} needs a URL for SSH, not {url!r}")
    return Repo(name, url, **_options(raw, base), boundedContexts=_contexts(raw.get("boundedContexts"), name))


def _contexts(raw, repo: str) -> list[dict]:
    if not isinstance(raw or [], list):
        raise ConfigError(f"bounded contexts of {repo!r} must be a list")
    out: dict[str, dict] = {}
    for e in raw or []:
        key = e.get("id") if isinstance(e, dict) else None
        if not isinstance(key, str) or not key:
            raise ConfigError(f"a bounded context of {repo!r} has no id")
        if key in out:
            raise ConfigError(f"bounded context {key!r} of {repo!r} is there twice")
        paths = [p for p in e["paths"] if isinstance(p, str) and p] if isinstance(e.get("paths"), list) else []
        if not paths:
            raise ConfigError(f"bounded context {key!r} of {repo!r} has no paths")
        out[key] = {"id": key, "paths": paths} | {k: e[k] for k in ("name", "description") if isinstance(e.get(k), str)}
    return list(out.values())


def contexts(spark: SparkSession, found: list[Repo]) -> tuple[DataFrame, DataFrame]:
    """Rows of ``bounded_contexts``, and the patterns in the order of their declaration."""
    nodes = [(r.name, c["id"], c.get("name"), c.get("description")) for r in found for c in r.boundedContexts]
    patterns = [(r.name, c["id"], p, i) for r in found for i, (c, p) in enumerate((c, p) for c in r.boundedContexts for p in c["paths"])]
    return spark.createDataFrame(nodes, "repo string, contextId string, name string, description string"), spark.createDataFrame(patterns, "repo string, contextId string, pattern string, declarationOrder int")
