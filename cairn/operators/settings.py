"""Contracts that run no job: release labels, sweeps of settings, sections."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from cairn.operators.steps import REGISTRY

# Column prefixes, and how slim copies are marked.
SLIM_KEYS, SLIM_SUFFIX = "slim_", "-slim"
VERSION_IN_PATH = re.compile(r"v\d+(?:\.\d+)+")
SECTIONS = ("id__", "y__", "raw__", "cat__", "cov__", "qf__", "__fold__")


def column_sections(columns: Iterable[str]) -> dict[str, int]:
    """How many columns each prefix has; one that fits none is an error."""
    out: Counter = Counter()
    for c in columns:
        section = next((s for s in SECTIONS if c.startswith(s)), None)
        if section is None:
            raise ValueError(f"column {c} is of no section")
        out[section] += 1
    return dict(out)


def release_label(metadata: Mapping[str, str], path: str = "") -> str:
    """A release's name: the first of what its metadata say and a version in
    the path. Slim copies say so. None is refused, never guessed."""
    said = [metadata.get(k) for k in ("release", "version")] + VERSION_IN_PATH.findall(path)
    label = next(filter(None, said), None)
    if label is None:
        raise ValueError("the release has no label")
    is_slim = bool({k for k in metadata if k[: len(SLIM_KEYS)] == SLIM_KEYS})
    return label + SLIM_SUFFIX * is_slim


@dataclass(frozen=True)
class Setting:
    name: str
    mutation_selector: str = "top_n"
    top_n: int | None = 100
    fold_strategy: str = "group"


def sweep(rows: Iterable[Mapping[str, str]]) -> list[Setting]:
    """Settings from rows of text: blanks take the default, `all` is no limit,
    selectors that read the label and repeated names are refused."""
    out: list[Setting] = []
    for r in rows:
        given = {k: v.strip() for k, v in r.items() if v and v.strip()}
        if "top_n" in given:
            given["top_n"] = None if given["top_n"] == "all" else int(given["top_n"])
        setting = Setting(**given)
        if setting.mutation_selector in ("chi2", "mi") or (setting.mutation_selector in REGISTRY and not REGISTRY[setting.mutation_selector].label_free):
            raise ValueError(f"{setting.mutation_selector} reads the label: not at mart time")
        if setting.mutation_selector not in ("top_n", "seeded", "all"):
            raise ValueError(f"unknown selector {setting.mutation_selector}")
        if setting.name in {s.name for s in out}:
            raise ValueError(f"setting {setting.name} twice")
        out.append(setting)
    return out
