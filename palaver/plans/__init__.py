"""Registered queries and their reference SQL."""

from __future__ import annotations

from palaver.plans.registry import Registry


def registries() -> list[Registry]:
    """The registries of the core."""
    from palaver.plans import landscape, network, practices, problems, relational, textual

    return [m.REGISTRY for m in (problems, relational, network, landscape, textual, practices)]
