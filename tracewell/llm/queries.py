"""All registered queries of this subpackage, and the pipeline made of its operators."""

import corpus_pipeline

from tracewell.llm import (  # noqa: F401
    classifier_queries,
    conversation_queries,
    native_queries,
    text_queries,
    vector_queries,
)
from tracewell.llm.registry import ORACLES, QUERIES, query

query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)

__all__ = ["ORACLES", "QUERIES"]
