"""Research projects: validated settings read from JSON."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field
from pathlib import Path

RUNNABLE = ("product_market", "price_monitoring")
MODES = ("domain", "discovery", "expedition")


@dataclass
class Project:
    project_id: str
    name: str = ""
    research_type: str = "product_market"
    entity_type: str = "product"
    seed_urls: list[str] = field(default_factory=list)
    keywords: list[str] = field(default_factory=list)
    negative_keywords: list[str] = field(default_factory=list)
    mode: str = "domain"
    max_pages: int = 60
    max_depth: int = 4
    max_domains: int = 20
    delay_seconds: float = 2.0

    def __post_init__(self):
        problems = []
        if not re.fullmatch(r"[a-z0-9][a-z0-9_-]{1,63}", self.project_id):
            problems.append("project_id must be 2 to 64 of a-z, 0-9, _ and -")
        if self.research_type not in RUNNABLE:
            problems.append(f"research_type must be one of {RUNNABLE}")
        if self.mode not in MODES:
            problems.append(f"mode must be one of {MODES}")
        problems += [f"seed URL must be http or https: {u}" for u in self.seed_urls if not u.lower().startswith(("http://", "https://"))]
        problems += [f"{n} is out of range" for n in ("max_pages", "max_depth", "max_domains") if getattr(self, n) < (0 if n == "max_depth" else 1)]
        if problems:
            raise ValueError("; ".join(problems))


def load(path: str) -> Project:
    raw = json.loads(Path(path).read_text(encoding="utf-8-sig"))
    return Project(**{k: v for k, v in raw.items() if k in Project.__dataclass_fields__})


def save(project: Project, path: str) -> None:
    Path(path).write_text(json.dumps(asdict(project), indent=2, ensure_ascii=False) + "\n", encoding="utf-8")


#: Kinds of research; those in RUNNABLE can be run (fixed values).
TEMPLATES = ("product_market", "price_monitoring", "competitor_research", "service_market", "trend_research")
PRESETS: dict[str, dict] = {
    "generic_products": {"project_id": "generic_products", "name": "Product market", "seed_urls": ["https://example.com"], "keywords": ["product", "price", "shop"], "mode": "domain", "max_pages": 40, "max_depth": 4, "max_domains": 1},
    "price_watch": {"project_id": "price_watch", "name": "Prices of known sources", "research_type": "price_monitoring", "seed_urls": ["https://example.com"], "keywords": ["price"], "mode": "discovery", "max_pages": 60, "max_depth": 3, "max_domains": 5},
}


def preset(name: str) -> Project:
    """A project as a preset gives it."""
    if name not in PRESETS:
        raise KeyError(name)
    return Project(**PRESETS[name])
