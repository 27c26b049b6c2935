"""All queries but those of the llm subpackage. Importing this fills the catalog."""

from __future__ import annotations

from snapstats.plans import q_awards, q_commands, q_loads, q_models, q_relational, q_reports, q_scalars, q_sequences, q_squad, q_streaming, q_windows  # noqa: F401
from snapstats.plans.catalog import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
