"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from siltstone.llm import credentials, distinctive, leakage, mixture, neighbours, origin, sentences, split


def queries() -> dict:
    return {
        "p1_found": credentials.p1_found, "p1_redacted": credentials.p1_redacted,
        "p2_scores": distinctive.p2_scores,
        "p4_found": split.p4_found, "p4_pieces": split.p4_pieces,
        "p5_found": origin.p5_found,
        "p6_found": neighbours.p6_found, "p6_neighbours": neighbours.p6_neighbours,
        "p7_found": leakage.p7_found, "p9_found": sentences.p9_found,
        "p8_mixture": mixture.p8_mixture, "p8_shares": mixture.p8_shares, "p8_filled": mixture.p8_filled, "p8_filled_shares": mixture.p8_filled_shares,
    }


def oracle_sql() -> dict:
    return distinctive.SQL | split.SQL | neighbours.SQL
