"""All registered queries with their SQL oracles, by operator family."""

from __future__ import annotations

from . import beam_q, echo_q, functions_q, grid_q, io_q, model_q, series_q, shape_q, solver_q, streaming_q, survey_q, track_q  # noqa: F401  they register themselves
from .registry import QUERIES, SQL  # noqa: F401

FLAGSHIP = "a01_grid_statistics"
