"""All queries that the driver registers for this subpackage: the operators' and the pipeline's."""

from __future__ import annotations

import corpus_pipeline
from plinth.llm import queries

QUERIES = dict(queries.QUERIES) | {"pipeline": corpus_pipeline.run}
ORACLE_SQL = dict(queries.ORACLE_SQL) | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
