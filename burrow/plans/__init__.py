from burrow.plans import (  # noqa: F401
    frame_queries,
    live_queries,
    network_queries,
    path_queries,
    place_queries,
    source_queries,
    file_queries,
    session_queries,
    scale_queries,
)
from burrow.plans.registry import ORACLES, QUERIES  # noqa: F401
