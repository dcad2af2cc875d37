"""Queries of the engine's operators over the driver's tables, each with the SQL of its oracle."""
