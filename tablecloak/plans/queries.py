"""All registered queries."""

from tablecloak.plans import (queries_catalog, queries_files, queries_mask,  # noqa: F401
                              queries_schema)
from tablecloak.plans.registry import ORACLES, QUERIES  # noqa: F401
