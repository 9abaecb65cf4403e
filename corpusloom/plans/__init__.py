"""Importing this package registers all queries."""

from . import builders, corpus, designs, files, formats, learned, linked, messages, metrics, relations, replays, reports, sequences
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "builders", "corpus", "designs", "files", "formats", "learned", "linked", "messages", "metrics", "relations", "replays", "reports", "sequences"]
