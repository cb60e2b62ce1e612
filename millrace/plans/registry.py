"""All registered queries and their oracles."""

from millrace.plans import catalog_files, catalog_options, catalog_study  # noqa: F401  registering
from millrace.plans.catalog import QUERIES, SQL, panel

__all__ = ["QUERIES", "SQL", "panel"]
