"""Structured Streaming: score arriving entity rows with the fitted models."""

from cohortlab.streaming.scoring import score_entities, start_scoring

__all__ = ["score_entities", "start_scoring"]
