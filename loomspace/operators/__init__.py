"""Retrieval, graph, topic, session, curation and evaluation operators over DataFrames."""
