"""Registered queries. Importing this package registers them all."""

from quillmart.plans import books, choices, market, papers, places, sales, search, simulations, streams
from quillmart.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "books", "choices", "market", "papers", "places", "sales", "search", "simulations", "streams"]
