"""The named queries over the tables of a data folder, each with the SQL it is compared with."""

from __future__ import annotations

import importlib

from proselake.plans.registry import QUERIES, SQL, Query

FLAGSHIP = "core_metrics"
MODULES = ("operators.views", "operators.core_metrics", "operators.style", "operators.rhythm", "operators.lexical", "operators.compare", "operators.sequences", "operators.conversation", "operators.catalogue", "operators.quality", "operators.similarity", "operators.reports", "streaming.findings", "operators.profiles", "operators.named_sequences", "operators.sequence_features", "operators.profile_checks", "operators.dialogue", "operators.reuse", "operators.graphs", "operators.pair_statistics", "operators.stylometry", "operators.rules", "plans.relational", "operators.drift", "operators.affect")
for _m in MODULES:
    importlib.import_module(f"proselake.{_m}")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
