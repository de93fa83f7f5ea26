"""Query plans; importing this package registers all of them."""

from . import documents, evidence, fields, geometry, greedy, rows, sources, text  # noqa: F401
