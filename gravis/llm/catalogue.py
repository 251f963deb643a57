"""Every registered query of the subpackage and its oracle texts."""

from __future__ import annotations

import corpus_pipeline
from gravis.llm import (  # noqa: F401  (importing registers the queries)
    bpe, credentials, idfile, interaction, jaccard, language, lexical, licences, mtree, packing, quality, siteextract, urlfilter,
)
from gravis.llm.registry import ORACLE, QUERIES, register

register("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
