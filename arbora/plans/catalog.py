"""Import every query module so the registry is complete."""

from arbora.plans import q_classify, q_corpus, q_metrics, q_offers, q_runs, q_sources, q_splits, q_taxonomy, q_text  # noqa: F401
from arbora.plans.registry import NOTES, ORACLE, QUERIES  # noqa: F401
