"""All queries of the library and their SQL."""

from .queries import ORACLE_SQL, QUERIES, builds, causal, discovery, entities, graphs, indexes, lookups, metrics, profiles, relations, search, sessions, sparse, storage, streams, temporal, topics, upkeep, vectors  # noqa: F401
