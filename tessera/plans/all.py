"""Imports every operator module, so that its queries are registered."""

from tessera.operators import records  # noqa: F401
from tessera.operators import pixels  # noqa: F401
from tessera.operators import geo, metrics  # noqa: F401
from tessera.operators import edits, engine_queries, enhance, flow_queries, files, labels, lifecycle, sampling, training  # noqa: F401
