"""Registered queries, grouped by theme. Importing this package fills the registry."""

from cumulus.plans import clouds, manifolds, reports, stores, topology  # noqa: F401
from cumulus.plans.registry import QUERIES, SQL  # noqa: F401
