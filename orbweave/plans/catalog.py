"""All registered queries; importing this module fills the registry."""

from orbweave.plans import (  # noqa: F401
    catalog_tracks, catalog_temporal, catalog_rim, catalog_decide, catalog_tables,
    catalog_trajectory, catalog_models)
from orbweave.plans.registry import ORACLES, QUERIES  # noqa: F401
