"""Whole-table queries over the operators, each with the SQL it must agree with."""

from importlib import import_module


def all_queries():
    for module in ("text_columns", "preparation", "feature_space", "retrieval", "steering_rules", "playlists", "evaluation", "trained"):
        import_module(f"crossweft.checks.{module}")
    from crossweft.checks.registry import REGISTRY

    return REGISTRY
