"""Every query of the memory engine by name, and the DuckDB SQL it is compared with."""

from __future__ import annotations

from sparkrecall.queries import functions, layered, memories

QUERIES = functions.QUERIES | memories.QUERIES | layered.QUERIES
SQL = functions.SQL | memories.SQL | layered.SQL
