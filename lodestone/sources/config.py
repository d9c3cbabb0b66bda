"""Configurations: YAML files where the more specific one wins, and rule packs made from them."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import replace
from pathlib import Path
from typing import Any

from lodestone.functions.rules import IRON, ScreenPack


# Variables that hold settings, and the folders of a config's output.
VARIABLES = {"openalex_email": "OPENALEX_EMAIL", "semantic_scholar_api_key": "SEMANTIC_SCHOLAR_API_KEY", "unpaywall_email": "UNPAYWALL_EMAIL"}
FOLDERS = ("outputs_dir", "papers_api_dir", "papers_manual_dir", "logs_dir", "data_subdir")


def merged(base: dict[str, Any], over: dict[str, Any]) -> dict[str, Any]:
    """Maps are merged key by key; lists and single values are replaced as a whole."""
    return base | {k: merged(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}


def load(path: str | Path, base: str | Path | None = None) -> dict[str, Any]:
    import yaml

    own = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    return merged(yaml.safe_load(Path(base).read_text(encoding="utf-8")) or {}, own) if base else own


def screen_pack(config: dict[str, Any], default: ScreenPack = IRON) -> ScreenPack:
    """The metal and the exclusion terms of a config, universal ones first; signals stay those of the default."""
    metal, rules = config.get("metal", {}), config.get("screening", {})
    terms = [*rules.get("universal_exclusion_terms", []), *rules.get("metal_exclusion_terms", [])]
    other = " ".join(rules.get("other_metal_regex", "").split())
    return replace(
        default, name=metal.get("name", default.name), symbol=metal.get("symbol", default.symbol), metal=metal.get("regex", default.metal), other_metal=other or default.other_metal, exclusions=tuple(terms) or default.exclusions,
    )


def settings(config: dict[str, Any], env: Mapping[str, str] = os.environ) -> dict[str, str]:
    """Contacts and keys of services: the environment's where it has them, else the config's, else ''."""
    search = config.get("search", {})
    return {name: env.get(variable, search.get(name, "")) for name, variable in VARIABLES.items()}


def load_project(path: str | Path, base: str | Path | None, root: str | Path) -> dict[str, Any]:
    """A config over its base, with the folders of its output below the project's root."""
    config = load(path, base)
    output = config.setdefault("output", {})
    for key in FOLDERS:
        if output.get(key) and not Path(output[key]).is_absolute() and "://" not in output[key]:
            output[key] = str(Path(root) / output[key])
    return config


def with_limits(config: dict[str, Any], **limits: int | None) -> dict[str, Any]:
    """The config with the search limits that are given in place of its own."""
    return merged(config, {"search": {k: v for k, v in limits.items() if v}})
