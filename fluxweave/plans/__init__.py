"""Registered queries over the engine's operators."""

from fluxweave.plans import detect, evidence, files, models, objects  # noqa: F401
from fluxweave.plans.registry import COVERS, QUERIES, SQL  # noqa: F401
