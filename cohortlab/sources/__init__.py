"""Sources: table scans (Parquet / CSV with NA tokens) and the analysis views."""

from cohortlab.sources.fixtures import document_view, embedding_view, entity_view, event_values
from cohortlab.sources.tables import read_entities, read_table, shape_report

__all__ = ["document_view", "embedding_view", "entity_view", "event_values", "read_entities", "read_table", "shape_report"]
