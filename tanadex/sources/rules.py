"""Extraction rules: which pages they apply to and what they read."""

from __future__ import annotations

import logging
from dataclasses import dataclass, field
from pathlib import Path

import yaml

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class FieldRule:
    """Where one field's value comes from inside an item's markup."""

    patterns: tuple[str, ...]
    attr: str | None = None
    attr_candidates: tuple[str, ...] = ()
    text: bool = False
    transforms: tuple[dict, ...] = ()


@dataclass(frozen=True)
class Profile:
    """One rule set. ``chains`` holds strategy chains, ``fields`` element rules."""

    name: str
    domains: tuple[str, ...] = ()
    url_regex: str | None = None
    priority: int = 0
    site: str | None = None
    category: str | None = None
    parse_type: str = "single"
    item_patterns: tuple[str, ...] = ()
    fields: dict[str, FieldRule] = field(default_factory=dict)
    chains: dict[str, tuple[dict, ...]] = field(default_factory=dict)
    post: tuple[dict, ...] = ()


def parse_profile(data: dict) -> Profile:
    """A profile from its configuration. Keys about fetching and paging are accepted unread."""
    match = data.get("match") or {}
    parse = data.get("parse")
    fields, chains = {}, {}
    if parse is not None:
        fields = {name: _field_rule(spec) for name, spec in (parse.get("fields") or {}).items()}
    else:
        chains = {name: tuple({"type": s["type"], **(s.get("config") or {})} for s in specs)
                  for name, specs in (data.get("fields") or {}).items()}
    parse = parse or {}
    return Profile(
        name=data.get("name") or data.get("id") or "unnamed_profile",
        domains=tuple(match.get("domains") or ()), url_regex=match.get("url_regex"),
        priority=match.get("priority", 0), site=data.get("site"), category=data.get("category"),
        parse_type=parse.get("type", "single"),
        item_patterns=tuple(parse.get("item_patterns") or ()), fields=fields, chains=chains,
        post=tuple(_flat(step, "method") for step in parse.get("post_list_process") or ()))


def _flat(step: dict, kind: str) -> dict:
    """Parameters may be nested below ``config`` or written beside the kind."""
    return {kind: step[kind], **(step["config"] if "config" in step else
                                 {k: v for k, v in step.items() if k != kind})}


def _field_rule(spec: dict) -> FieldRule:
    patterns = spec.get("patterns") or ([spec["pattern"]] if spec.get("pattern") else [])
    return FieldRule(tuple(patterns), spec.get("attr"), tuple(spec.get("attr_candidates") or ()),
                     bool(spec.get("text", False)),
                     tuple(_flat(t, "type") for t in spec.get("transforms") or ()))


def by_priority(profiles) -> list[Profile]:
    """Highest priority first; equal ones keep their order."""
    return sorted(profiles, key=lambda p: -p.priority)


def load_profiles(path: str) -> list[Profile]:
    """Profiles of a YAML file or of a directory; a file that fails is skipped with a warning."""
    root = Path(path)
    files = [root] if root.is_file() else [*sorted(root.glob("*.yaml")), *sorted(root.glob("*.yml"))]
    if not files:
        raise FileNotFoundError(f"no rule files below {path}")
    profiles: list[Profile] = []
    for file in files:
        try:
            data = yaml.safe_load(file.read_text(encoding="utf-8"))
            entries = data.get("profiles", []) if "profiles" in (data or {}) else [data] if data else []
            profiles += [parse_profile(entry) for entry in entries]
        except Exception as problem:  # a broken rule file must not stop the others
            log.warning("rules of %s skipped: %s", file, problem)
    return by_priority(profiles)
