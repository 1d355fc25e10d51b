"""All checks, imported for their registration."""

from checks import intervals, pipelines, points, scalars, scenes, segments, selection, sources, streams, vectors  # noqa: F401
from checks.roles import ORACLES, QUERIES  # noqa: F401
