"""All registered queries."""

from __future__ import annotations

from changemap.plans import q_features, q_geo, q_io, q_labels, q_model, q_predict

MODULES = (q_features, q_labels, q_predict, q_geo, q_model, q_io)


def queries():
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql():
    return {k: s for m in MODULES for k, s in m.ORACLES.items()}
