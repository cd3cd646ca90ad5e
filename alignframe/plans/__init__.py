"""Compositions: task loaders, input fixtures and the query registry."""
