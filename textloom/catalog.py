"""Imports every module that registers queries."""

from textloom.operators import analytics, cascade, chats, checks, chunking, cleanup, documents, entities, fields, handlers, linking, mutations, profiles, readings, reports, retrieval, rules, scans, vocabulary  # noqa: F401
from textloom.plans import dispatch, ingest, pages  # noqa: F401
from textloom.registry import ORACLES, QUERIES  # noqa: F401
from textloom.sources import cards, parsers  # noqa: F401
from textloom.streaming import limits, streams  # noqa: F401

FLAGSHIP = "hybrid_fusion"
