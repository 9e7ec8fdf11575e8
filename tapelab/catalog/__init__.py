"""All runnable queries. Importing this package registers them."""

from tapelab.catalog import audit, routes, scan, streams, studies, trades  # noqa: F401
from tapelab.catalog.base import ORACLES, QUERIES  # noqa: F401
