"""All registries of the core library."""

from __future__ import annotations

from starloom.plans import (
    catalog_queries,
    file_queries,
    grid_queries,
    label_queries,
    model_queries,
    particle_queries,
    pipeline_queries,
    stats_queries,
    stream_queries,
    validation_queries,
)
from starloom.plans.registry import Registry

MODULES = (
    pipeline_queries,
    particle_queries,
    catalog_queries,
    grid_queries,
    label_queries,
    stats_queries,
    model_queries,
    file_queries,
    stream_queries,
    validation_queries,
)


def registries() -> list[Registry]:
    return [module.registry for module in MODULES]
