"""All queries over the given tables."""

from larder.plans import curation, functions, imports, jobs, recognition, relational, rules, sources
from larder.plans.base import QUERIES, SQL

flagship = relational.recipes_per_ingredient

__all__ = ["QUERIES", "SQL", "curation", "flagship", "functions", "imports", "jobs", "recognition", "relational", "rules", "sources"]
