"""Adapter views over the driver tables and the registered queries with their oracles."""
