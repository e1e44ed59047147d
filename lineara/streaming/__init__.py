"""Structured Streaming: following a chain with reorganisations, windows over events, and stateful watches."""
