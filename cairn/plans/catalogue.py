"""All registries of the core library, in one place."""

from __future__ import annotations

from cairn.plans import content, general, imports, relational, reports, search, streams, views
from cairn.plans.registry import Registry

FLAGSHIP = "search_segments"


def registries() -> list[Registry]:
    """The core library's query registries."""
    return [general.R, relational.R, search.R, content.R, streams.R, imports.R, views.R, reports.R]
