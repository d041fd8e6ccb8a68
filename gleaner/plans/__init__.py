"""The registered queries, one module per family."""

from importlib import import_module

FAMILIES: tuple[str, ...] = ("trends", "text", "identity", "claims", "landscape", "surfaces", "research", "streams", "validation", "extraction", "served")


def load_all() -> None:
    for family in FAMILIES:
        import_module(f"gleaner.plans.{family}")
