"""Every registered query of this subpackage, and the SQL for those that SQL can express."""

from __future__ import annotations

from . import (ann, bpe, importance, langid, mixing, ngram_join, packing, secrets, sharding, suffix_dedup, tokenfile, topk, variants)

_MODULES = [mixing, langid, ngram_join, topk, bpe, suffix_dedup, tokenfile, ann, secrets, sharding, importance, variants, packing]


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracles() -> dict:
    return {k: v for m in _MODULES for k, v in m.ORACLES.items()}
