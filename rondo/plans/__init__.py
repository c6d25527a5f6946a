"""Query plans: each module registers named queries when imported."""

from importlib import import_module

MODULES: tuple[str, ...] = ("note_plans", "window_plans", "tag_plans", "vector_plans", "text_plans", "contour_plans", "level_plans", "run_plans")


def load_all() -> None:
    for m in MODULES:
        import_module(f"rondo.plans.{m}")
