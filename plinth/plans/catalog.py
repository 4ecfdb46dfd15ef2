"""Imports every plan module, so that its queries are registered."""

from plinth.plans import q_gates, q_intake, q_keys, q_models, q_relational, q_sources, q_stats, q_stream, q_text  # noqa: F401
