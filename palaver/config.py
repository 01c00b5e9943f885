"""Parameters as frozen dataclasses; unknown names are rejected by construction, overrides go through dataclasses.replace.

The defaults are fixed values that results must share.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class GraphConfig:
    """Edges and centralities."""

    edge_direction: str = "asker_to_answerer"
    drop_self_answers: bool = True
    exclude_user_ids: tuple[int, ...] = (0,)
    valid_year_min: int = 2021
    valid_year_max: int = 2026
    min_edges_per_year: int = 200
    pagerank_alpha: float = 0.85
    pagerank_max_iter: int = 200
    pagerank_tol: float = 1e-9
    hits_max_iter: int = 500
    hits_tol: float = 1e-10
    eigenvector_max_iter: int = 1000
    eigenvector_tol: float = 1e-10
    katz_max_iter: int = 1000
    katz_tol: float = 1e-10
    one_task: int = 2_000_000  # edges up to which the short steps of an iteration run in one task
    expensive_max_edges: int = 20_000_000
    katz_alpha: float = 0.005
    katz_beta: float = 1.0
    betweenness_sample: int = 500
    expensive_max_nodes: int = 20_000
    expensive_top_n: int = 5_000
    louvain_resolution: float = 1.0


@dataclass(frozen=True)
class AuthorityConfig:
    """How several authority signals are joined into one score."""

    pagerank_weight: float = 0.5
    reputation_weight: float = 0.3
    accept_rate_weight: float = 0.2
    overlap_high: float = 0.8
    overlap_low: float = 0.5
    calibration_top_n: int = 200


@dataclass(frozen=True)
class ShapeConfig:
    """Thresholds of the consensus labels."""

    top1_consensus: float = 0.40
    gap_consensus: float = 0.15
    top2_polarization: float = 0.60
    agree_fragile: float = 0.60
    single_voice: float = 0.50
    min_cluster: int = 2
    votings: int = 3


@dataclass(frozen=True)
class RetrievalConfig:
    """Candidates, gate and reuse of groups."""

    top_k: int = 100
    threshold: float = 0.30
    accept_confidence: float = 0.50
    dedup_threshold: float = 0.50
