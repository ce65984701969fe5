"""Queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from tidemark.llm import (
    ann,
    bpe_automaton,
    chat,
    hard_negatives,
    jaccard_join,
    lang,
    main_text,
    packing,
    piece_table,
    pieces,
    sharding,
    suffix_dedup,
    topk,
)

_MODULES = (ann, jaccard_join, lang, main_text, packing, pieces, sharding, chat, suffix_dedup, topk, hard_negatives, bpe_automaton, piece_table)


def queries() -> dict:
    return {name: build for m in _MODULES for name, build in m.QUERIES.items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    sql = {name: text for m in _MODULES for name, text in getattr(m, "ORACLE", {}).items()}
    return sql | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
