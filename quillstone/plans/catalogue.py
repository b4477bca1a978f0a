"""All of the engine's registered queries, and the SQL of those that SQL can express."""

from . import exchange, lexical, projection, reference, retrieval, truths

MODULES = (reference, truths, projection, retrieval, lexical, exchange)
QUERIES, ORACLES, TABLES = reference.QUERIES, reference.ORACLES, reference.TABLES
