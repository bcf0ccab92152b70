"""Queries of the corpus operators and their SQL."""

from __future__ import annotations

from mediacat.llm import collocations, decontamination, filter_audit, language_id, ngram_join, packing, piece_codec, pii, quality_rules, sharding, suffix_dedup, toxicity, url_filter

_MODULES = (quality_rules, sharding, url_filter, language_id, toxicity, packing, pii, decontamination, ngram_join, suffix_dedup, piece_codec, filter_audit, collocations)


def queries() -> dict:
    found = {name: getattr(m, name) for m in _MODULES for name in dir(m) if name.startswith("op") and name[2].isdigit()}
    return {**found, "quality_ablations": quality_rules.quality_ablations}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in getattr(m, "SQL", {}).items()}
