"""The query catalogue; importing the package registers every query."""

from . import catalog, records, runs, scores  # noqa: F401
