"""Operators over DataFrames: stores, sync, manifests, graphs, vectors."""

from . import extract, graph, index, knowledge, manifest, store, sync, tickets, vector
from .store import RecordStore
from .vector import HashedIndex

__all__ = ["HashedIndex", "RecordStore", "extract", "graph", "index", "knowledge", "manifest", "store", "sync", "tickets", "vector"]
