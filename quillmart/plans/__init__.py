"""The query catalogue."""

from quillmart.plans import attribution, blocking, canonical, coverage, decisions, events, exchange, intake, listing, mart, merging, names, queueing, resolution, ruletables, screening, subjects, texts, upserting, workflow  # noqa: F401
from quillmart.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
