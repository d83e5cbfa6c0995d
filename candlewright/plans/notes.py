"""Graphs kept in markdown notes: frontmatter, slug check, validation again on every load."""

from __future__ import annotations

import json
import re

from candlewright.plans.graph import GraphError, validate

_SLUG = re.compile(r"^[a-z0-9][a-z0-9_-]{0,63}$")
_FRONT = re.compile(r"\A---\n(.*?)\n---", re.S)


def to_note(slug: str, graph: dict, title: str = "") -> str:
    """A note whose frontmatter holds the graph as JSON."""
    if not _SLUG.match(slug):
        raise ValueError(f"bad slug {slug!r}")
    if errors := validate(graph).errors:
        raise GraphError(errors)
    return f"---\ntype: signal_graph\nslug: {slug}\ngraph: {json.dumps(graph, sort_keys=True)}\n---\n# {title or slug}\n"


def from_note(text: str) -> tuple[str, dict]:
    """(slug, graph) of a note; raises where there is none or it doesn't validate."""
    m = _FRONT.match(text)
    fields = dict(line.split(": ", 1) for line in (m.group(1).splitlines() if m else []) if ": " in line)
    if "graph" not in fields or not _SLUG.match(fields.get("slug", "")):
        raise ValueError("no graph note")
    graph = json.loads(fields["graph"])
    if errors := validate(graph).errors:
        raise GraphError(errors)
    return fields["slug"], graph
