"""All registered queries."""

from __future__ import annotations

from retailscope.plans import contacts, feed, grading, landed, leads, pages, runs, streams, views, writes
from retailscope.plans.registry import Query

MODULES = (views, feed, runs, writes, grading, pages, contacts, leads, landed, streams)


def all_queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for module in MODULES:
        clash = out.keys() & module.registry.queries.keys()
        if clash:
            raise ValueError(f"registered twice: {sorted(clash)}")
        out.update(module.registry.queries)
    return out
