"""All named queries; importing this module loads every plan module."""

from lodestrata.plans import REGISTRY

from lodestrata.plans import chunks, graph, health, labels, records, retrieval, states, store  # noqa: F401
