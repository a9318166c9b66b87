"""The reference-side query catalogue: name -> DataFrame builder, and name -> DuckDB SQL."""

from __future__ import annotations

from waymark.catalog import QUERIES, SQL, curves, demand, evidence, vectors

__all__ = ["QUERIES", "SQL", "curves", "demand", "evidence", "vectors"]
