"""All functions of the dialect."""

from docloom.functions import aggregates, arrays, conversion, dates, numbers, registry, strings

__all__ = ["aggregates", "arrays", "conversion", "dates", "numbers", "registry", "strings"]
