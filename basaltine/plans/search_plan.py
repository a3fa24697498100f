"""Search queries of a project: target, keyword bundles and pairs, in order of past yield."""

from __future__ import annotations

from itertools import combinations


def _clean(words: list[str]) -> list[str]:
    """Squeezed, non-empty, first of each spelling."""
    seen: dict[str, str] = {}
    for w in words:
        w = " ".join(w.split())
        if w:
            seen.setdefault(w.casefold(), w)
    return list(seen.values())


def plan(keywords: list[str], configured: list[str] = (), target: list[str] = (), required: list[str] = (), memory: dict[str, tuple[int, int]] | None = None, exclude: list[str] = (), limit: int = 10) -> list[str]:
    """Queries in order; ``memory`` maps a query in lower case to (runs, productive domains).

    Queries that found something before lead, untried ones follow, others end the list.
    """
    words = _clean(list(keywords))
    ideas = [*configured]
    if target:
        ideas += [" ".join(target), *[f"{' '.join(target)} {w}" for w in words[:3]]]
    if required:
        ideas.append(" ".join([*words[:2], *required]))
    if len(words) >= 3:
        ideas.append(" ".join(words[:3]))
    ideas += [f"{a} {b}" for a, b in combinations(words, 2)] + words
    skip = {" ".join(x.split()).casefold() for x in exclude}
    known = memory or {}

    def band(query: str) -> int:
        runs, productive = known.get(query.casefold(), (0, 0))
        return 0 if productive else 1 if not runs else 2

    fresh = [q for q in _clean(ideas) if q.casefold() not in skip]
    return sorted(fresh, key=band)[: max(0, limit)]
