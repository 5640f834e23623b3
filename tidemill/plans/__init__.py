"""All named queries. Importing this package fills the catalogue."""

from tidemill.plans import (  # noqa: F401
    aggregates,
    analytic,
    changes,
    domains,
    joins,
    masking,
    patterns,
    projection,
    quality,
    scalars,
    scoring,
    sources,
    streams,
    windows,
)
from tidemill.plans.catalog import ORACLES, QUERIES  # noqa: F401
