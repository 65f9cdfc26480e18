"""Queries over the driver tables; each module registers its keys when imported."""

from importlib import import_module

MODULES = (
    "geometry_queries", "score_queries", "text_queries", "table_queries", "tile_queries", "location_queries",
    "prediction_queries", "region_queries",
)


def load_catalog():
    for name in MODULES:
        import_module(f"placespark.plans.{name}")
    return import_module("placespark.plans.catalog")
