"""The part of a catalog that a question needs: scoring, shortest paths, bounded selection, rendering."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass

from quernel.catalog import Catalog, Table
from quernel.functions.surface import listing

WHOLE, SEEDS, DEPTH, MOST_TABLES, NEIGHBOURS, MOST_COLUMNS, MOST_OMITTED = 12, 3, 2, 5, 6, 8, 200
# Weights of a word found in a table's name, alias, description or column.
WEIGHTS = {"name": 10, "alias": 6, "description": 3, "column": 1}


def words(text: str) -> set[str]:
    """Words of a text, of three letters at least, and their plain singular and plural forms."""
    out: set[str] = set()
    for w in re.findall(r"[^\W_]{3,}", text.lower()):
        out.add(w)
        if w.endswith("ies") and len(w) > 4:
            out.add(w[:-3] + "y")
        if w.endswith("es") and len(w) > 4:
            out.add(w[:-2])
        if w.endswith("s") and len(w) > 3:
            out.add(w[:-1])
        else:
            out.add(w + "s")
    return out


def score(table: Table, asked: set[str]) -> int:
    """How well a table answers to the words of a question: each word counts once where it stands."""
    texts = {"name": table.name, "alias": " ".join(table.aliases), "description": table.description, "column": " ".join(f"{c.name} {c.description}" for c in table.columns)}
    return sum(WEIGHTS[place] * len(words(text) & asked) for place, text in texts.items())


def neighbours(catalog: Catalog) -> dict[str, set[str]]:
    out: dict[str, set[str]] = {t.name: set() for t in catalog.tables}
    for t in catalog.tables:
        for r in t.relationships:
            if r.target in out:
                out[t.name].add(r.target)
                out[r.target].add(t.name)
    return out


def shortest_path(links: dict[str, set[str]], start: str, end: str, depth: int = DEPTH) -> list[str] | None:
    """A shortest path of at most ``depth`` links, going out from the start ring by ring; of several the first in order of names."""
    before: dict[str, str] = {start: ""}
    ring = [start]
    for _ in range(depth):
        if end in before:
            break
        ring = [n for a in ring for n in sorted(links.get(a, ())) if before.setdefault(n, a) == a and n != start]
        ring = list(dict.fromkeys(ring))
    if end not in before:
        return None
    path = [end]
    while path[0] != start:
        path.insert(0, before[path[0]])
    return path


@dataclass(frozen=True)
class Context:
    tables: tuple[Table, ...]
    omitted: tuple[str, ...]
    scores: tuple[tuple[str, int], ...]


def select(catalog: Catalog, question: str, extra: set[str] = frozenset()) -> Context:
    """The tables for a question: all of a small catalog, else the best, those between them and near them."""
    some = [t for t in catalog.tables if t.queryable]
    asked = words(question)
    scored = sorted(((t.name, score(t, asked)) for t in some), key=lambda x: (-x[1], x[0]))
    if len(some) <= WHOLE:
        return Context(tuple(some), (), tuple(scored))
    links = neighbours(catalog)
    chosen = [n for n, s in scored[:SEEDS] if s > 0] or [scored[0][0]]
    chosen += [n for n in sorted(extra) if catalog.table(n) and n not in chosen]
    seeds = list(chosen)
    for a in seeds:
        for b in seeds:
            path = shortest_path(links, a, b)
            for n in path or []:
                if n not in chosen and len(chosen) < MOST_TABLES:
                    chosen.append(n)
    near = sorted({n for c in chosen for n in links[c]} - set(chosen), key=lambda n: (-dict(scored)[n] if n in dict(scored) else 0, n))
    chosen += near[:NEIGHBOURS]
    cut = tuple(_cut(t, asked) for t in some if t.name in chosen)
    omitted = tuple(sorted(t.name for t in some if t.name not in chosen))[:MOST_OMITTED]
    return Context(cut, omitted, tuple(scored))


def _cut(t: Table, asked: set[str]) -> Table:
    """The table with its keys, its links and the best of its other columns."""
    from dataclasses import replace

    must = {c.name for c in t.columns if c.primary_key} | {r.column for r in t.relationships}
    rest = sorted((c for c in t.columns if c.name not in must), key=lambda c: (not (words(c.name) & asked), t.columns.index(c)))
    kept = must | {c.name for c in rest[: max(0, MOST_COLUMNS - len(must))]}
    return replace(t, columns=tuple(c for c in t.columns if c.name in kept))


def render(context: Context, catalog: Catalog) -> dict:
    """The projection that a proposer may see: no hidden columns, stable ids, canonical JSON and its hash."""
    tables = []
    for t in sorted(context.tables, key=lambda t: t.name):
        shown = [c for c in t.columns if c.queryable and c.sensitivity != "confidential"]
        tables.append({"id": f"entity:{t.name}", "description": t.description, "attributes": [{"id": f"attribute:{t.name}:{c.name}", "type": c.type, "values": list(c.values) if c.values_complete else []} for c in shown]})
    names = {t.name for t in context.tables}
    links = sorted(f"relationship:{t.name}.{r.column}->{r.target}.{r.target_column}" for t in context.tables for r in t.relationships if r.target in names)
    body = {"entities": tables, "relationships": links, "omitted": list(context.omitted), "functions": listing()}
    text = json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return {"json": text, "sha256": hashlib.sha256(text.encode()).hexdigest(), "text": _compact(tables, links)}


def _compact(tables: list[dict], links: list[str]) -> str:
    lines = [f"{t['id'].split(':')[1]}({', '.join(a['id'].rsplit(':', 1)[1] + ' ' + a['type'] for a in t['attributes'])})" for t in tables]
    return "\n".join(lines + [x.removeprefix("relationship:") for x in links])
