"""Query bindings on the driver tables; importing this registers them all."""

from driftline.plans import (  # noqa: F401
    catalog, cleaning, dashboard, drift, incidents, io, logs, metrics, modeling, sampling, streams, training, versions)
from driftline.plans.registry import ORACLES, QUERIES  # noqa: F401
