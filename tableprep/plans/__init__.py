"""Registered queries: every operator on the given tables."""

from tableprep.plans import edges, guarding, modelling, scores, searching, sources, tablefacts, transforms  # noqa: F401
from tableprep.plans.modelling import flagship  # noqa: F401
