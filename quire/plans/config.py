"""Thresholds of the rules, with their defaults, and how to read them from a YAML file."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, replace
from pathlib import Path
from typing import Any

# The words that speak for a domain. Order matters, the first of equal domains wins.
DOMAIN_KEYWORDS = {
    "financial": ("revenue", "balance sheet", "fiscal", "audit", "expenditure", "profit", "assets", "liabilities"),
    "legal": ("whereas", "hereby", "clause", "agreement", "court", "plaintiff", "defendant", "pursuant"),
    "technical": ("implementation", "assessment", "methodology", "findings", "specification", "architecture", "deployment"),
    "medical": ("patient", "diagnosis", "treatment", "clinical", "medication", "therapy", "symptoms"),
}


@dataclass(frozen=True)
class OriginRules:
    min_chars_per_page: int = 50
    max_image_area_ratio: float = 0.5
    fraction_min: float = 0.1
    fraction_max: float = 0.9


@dataclass(frozen=True)
class LayoutRules:
    table_area_ratio: float = 0.25
    table_regions: float = 2
    figure_area_ratio: float = 0.4


@dataclass(frozen=True)
class DomainRules:
    cutoff: float = 0.3
    sample_pages: int = 5
    keywords: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(DOMAIN_KEYWORDS))


@dataclass(frozen=True)
class FastTextRules:
    min_chars_per_page: int = 50
    max_image_area_ratio: float = 0.5
    min_density: float = 1.0


@dataclass(frozen=True)
class RouterRules:
    fast_text: float = 0.5
    layout: float = 0.5
    vision: float = 0.0
    layout_default: float = 0.75
    vision_default: float = 0.8
    vision_pages: int = 50


@dataclass(frozen=True)
class Rules:
    origin: OriginRules = OriginRules()
    layout: LayoutRules = LayoutRules()
    domain: DomainRules = field(default_factory=DomainRules)
    fast_text: FastTextRules = FastTextRules()
    router: RouterRules = RouterRules()


# Where the file has each threshold, as (section, key).
FILE_KEYS = {
    "origin": {
        "min_chars_per_page": ("origin_type", "min_chars_per_page_digital"),
        "max_image_area_ratio": ("origin_type", "max_image_area_ratio_digital"),
        "fraction_min": ("origin_type", "fraction_pages_digital_min"),
        "fraction_max": ("origin_type", "fraction_pages_digital_max"),
    },
    "layout": {
        "table_area_ratio": ("layout_complexity", "table_area_ratio_heavy"),
        "table_regions": ("layout_complexity", "table_regions_per_page_heavy"),
        "figure_area_ratio": ("layout_complexity", "figure_area_ratio_heavy"),
    },
    "domain": {"cutoff": ("domain_hint", "confidence_cutoff"), "sample_pages": ("domain_hint", "sample_max_pages"), "keywords": ("domain_hint", "keywords")},
    "fast_text": {
        "min_chars_per_page": ("fast_text", "min_chars_per_page"),
        "max_image_area_ratio": ("fast_text", "max_image_area_ratio"),
        "min_density": ("fast_text", "min_char_density_per_10k_points2"),
    },
    "router": {
        "fast_text": ("router", "fast_text_confidence_threshold"),
        "layout": ("router", "layout_confidence_threshold"),
        "layout_default": ("layout", "confidence_default"),
        "vision_default": ("vision", "confidence_default"),
        "vision_pages": ("vision", "max_pages_per_document"),
    },
}


def rules_from(data: dict[str, Any]) -> Rules:
    """Rules from the sections of a file; what a section lacks keeps its default."""
    rules = Rules()
    for part, keys in FILE_KEYS.items():
        given = {name: data[s][k] for name, (s, k) in keys.items() if isinstance(data.get(s), dict) and data[s].get(k) is not None}
        if "keywords" in given:
            given["keywords"] = {str(d): tuple(str(w).lower() for w in words) for d, words in given["keywords"].items()}
        rules = replace(rules, **{part: replace(getattr(rules, part), **given)})
    return rules


def load_rules(path: str | Path | None = None) -> Rules:
    """Rules from a YAML file; the defaults without one, or where it can't be found."""
    if path is None or not Path(path).exists():
        return Rules()
    import yaml

    return rules_from(yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {})


def environment(folders: tuple[str | Path, ...] = (".", Path(__file__).parents[2])) -> dict[str, str]:
    """The settings of the first .env file in these folders, put into the environment where it has none of that name.

    Lines are NAME=value, the value in quotes or not; blank ones, comments and others are passed over.
    """
    found: dict[str, str] = {}
    for path in (Path(f) / ".env" for f in folders):
        if path.is_file():
            for line in path.read_text(encoding="utf-8").splitlines():
                name, sign, value = line.strip().partition("=")
                if sign and name.strip() and not name.startswith("#"):
                    found[name.strip()] = value.strip().strip("\"'")
            break
    for name, value in found.items():
        os.environ.setdefault(name, value)
    return found
