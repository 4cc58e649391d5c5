"""The registered queries on training data, the pipeline among them."""

from __future__ import annotations

import corpus_pipeline
from changemap.llm.queries import ORACLES, QUERIES


def queries():
    return QUERIES | {"pipeline": corpus_pipeline.run}


def oracle_sql():
    if corpus_pipeline.ORACLE_SQL is None:
        return dict(ORACLES)
    return ORACLES | {"pipeline": corpus_pipeline.ORACLE_SQL}
