"""What ``__spark_entry__`` registers from this subpackage."""

from __future__ import annotations

import corpus_pipeline
from lemmata.llm.queries import QUERIES
from lemmata.llm.sql import ORACLES


def queries() -> dict:
    return {**QUERIES, "pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES) | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
