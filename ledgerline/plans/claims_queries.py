"""All registered queries of the claims operators."""

from ledgerline.plans import banners, blocks, details, entities, grids, grounded, headers, layouts, reconciled, reviews, ruled, sheets, standardise, stored, tables, texts  # noqa: F401
from ledgerline.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
