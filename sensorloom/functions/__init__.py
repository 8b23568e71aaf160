from . import calendar, scalar

__all__ = ["calendar", "scalar"]
