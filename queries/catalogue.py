"""Imports every query module, so that the registry is full."""

from queries import checks, corpus, encoding, evaluation, features, lifecycle, scorecard, sources, streams, windows  # noqa: F401
from queries.registry import ORACLES, QUERIES  # noqa: F401
