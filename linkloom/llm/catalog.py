"""The registered queries of this subpackage."""

from __future__ import annotations

from linkloom.llm import (
    bpe_tree,
    byte_cnn,
    hidden_markov,
    jaccard_join,
    licenses,
    merkle,
    mixing,
    negatives,
    repetition,
    reply_trees,
    secret_scan,
    simple8b,
    templates,
)
from linkloom.llm.common import ORACLES, QUERIES

__all__ = [
    "ORACLES",
    "QUERIES",
    "bpe_tree",
    "byte_cnn",
    "hidden_markov",
    "jaccard_join",
    "licenses",
    "merkle",
    "mixing",
    "negatives",
    "repetition",
    "reply_trees",
    "secret_scan",
    "simple8b",
    "templates",
]
