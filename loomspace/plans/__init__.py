"""Constant tables of the engine and the composition of retrieval plans."""
