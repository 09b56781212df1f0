"""Registered queries (the driver contract) and end-to-end pipelines."""


def load_all():
    """Import every query module so that the registry is complete."""
    from . import queries_orders  # noqa: F401
    from . import queries_series  # noqa: F401
    from . import queries_long  # noqa: F401
    from . import queries_words  # noqa: F401
    from . import queries_items  # noqa: F401
    from . import queries_models  # noqa: F401
    from . import queries_stream  # noqa: F401
    from . import queries_roundtrip  # noqa: F401
    from .registry import ORACLE, REGISTRY
    return REGISTRY, ORACLE
