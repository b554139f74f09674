"""All queries of this subpackage; importing the modules fills the registry."""

from strainshift.llm import q_alignment, q_decontaminate, q_html, q_merkle, q_neighbours, q_pieces, q_quality, q_rules, q_secrets, q_set_join, q_tokens, q_url_trust, q_warc  # noqa: F401
from strainshift.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
