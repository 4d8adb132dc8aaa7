"""Reference queries, each a DataFrame plan with its oracle; importing registers them all."""

from . import boards, catalog, extraction, guards, listings, page_products, pricing, records, relations, replies, storefronts

__all__ = ["boards", "catalog", "extraction", "guards", "listings", "page_products", "pricing", "records", "relations", "replies", "storefronts"]
