"""Registered queries: an operator on a view of the test tables, with its SQL check."""

from cladeframe.plans import (
    alignments,
    chains,
    codons,
    likelihoods,
    mappings,
    samples,
    scores,
    splitlists,
    texts,
    treelists,
)

MODULES = [alignments, codons, chains, scores, splitlists, treelists, likelihoods, mappings, samples, texts]


def all_queries() -> dict:
    return {name: fn for m in MODULES for name, fn in m.QUERIES.items()}


def all_sql() -> dict[str, str]:
    return {name: text for m in MODULES for name, text in m.SQL.items()}
