"""Resolution of conflicting record metadata on Spark; these are the functions to start with."""

from concord.api import arbitrate, calibrate, coverage, normalise, project_tags, ranking, rearbitrate, resolve, resolve_and_arbitrate, score, search, status

__all__ = ["arbitrate", "calibrate", "coverage", "normalise", "project_tags", "ranking", "rearbitrate", "resolve", "resolve_and_arbitrate", "score", "search", "status"]
