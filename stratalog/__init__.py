"""Spark-native analytics for catalogues of material samples.

Entity tables with child tables of composition, location and citation rows are
queried, compared, exported, checked, merged and indexed as DataFrame plans.
"""

from stratalog.sources.catalog import Catalog

__all__ = ["Catalog"]
