"""Recipe-style data preparation on PySpark."""

_ENGINE = ("Config", "Engine", "FittedStatistics", "Instance", "materialize", "resolve_instance", "resolve_status")
__all__ = list(_ENGINE)


def __getattr__(name: str) -> object:
    if name in _ENGINE:
        from . import engine

        return getattr(engine, name)
    raise AttributeError(name)
