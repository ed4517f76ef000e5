"""Constants of the memory model. Values that must equal the modelled system's for right results are marked fixed."""

from __future__ import annotations

from dataclasses import dataclass

#: Sectors in their order, decay rate by day, classifier weight, embedder weight.
SECTORS = ["episodic", "semantic", "procedural", "emotional", "reflective"]
DECAY_LAMBDA = {"episodic": 0.015, "semantic": 0.005, "procedural": 0.008, "emotional": 0.02, "reflective": 0.001}
SECTOR_WEIGHT = {"episodic": 1.2, "semantic": 1.0, "procedural": 1.1, "emotional": 1.3, "reflective": 0.8}
EMBED_WEIGHT = {"episodic": 1.3, "semantic": 1.0, "procedural": 1.2, "emotional": 1.4, "reflective": 0.9}

#: Fusion weight of a sector if it is the query's primary one, and else.
FUSION = {"semantic": (1.2, 0.8), "emotional": (1.5, 0.6), "procedural": (1.3, 0.7), "episodic": (1.4, 0.7), "reflective": (1.1, 0.5)}

#: Resonance between sectors, rows and columns in the order of SECTORS.
RESONANCE = [[1.0, 0.7, 0.3, 0.6, 0.6], [0.7, 1.0, 0.4, 0.7, 0.8], [0.3, 0.4, 1.0, 0.5, 0.2], [0.6, 0.7, 0.5, 1.0, 0.8], [0.6, 0.8, 0.2, 0.8, 1.0]]

#: Penalty of a memory's sector under a query's sector; 0.3 where none is given.
RELATION = {
    "semantic": {"procedural": 0.8, "episodic": 0.6, "reflective": 0.7, "emotional": 0.4},
    "procedural": {"semantic": 0.8, "episodic": 0.6, "reflective": 0.6, "emotional": 0.3},
    "episodic": {"reflective": 0.8, "semantic": 0.6, "procedural": 0.6, "emotional": 0.7},
    "reflective": {"episodic": 0.8, "semantic": 0.7, "procedural": 0.6, "emotional": 0.6},
    "emotional": {"episodic": 0.7, "reflective": 0.6, "semantic": 0.4, "procedural": 0.3},
}

DAY_MS, HOUR_MS = 86_400_000, 3_600_000


@dataclass(frozen=True)
class Scoring:
    """Weights of the retrieval score and the parameters around it."""

    similarity: float = 0.35
    overlap: float = 0.20
    waypoint: float = 0.15
    recency: float = 0.10
    tags: float = 0.20
    keyword_boost: float = 2.5
    keyword_least: float = 0.05
    project_boost: float = 0.2
    tau: float = 3.0
    t_days: float = 7.0
    t_max: float = 60.0
    floor: float = 0.08
    fanout: float = 0.3
    confident: float = 0.55
    epsilon: float = 1e-8


@dataclass(frozen=True)
class Dynamics:
    """Salience dynamics, reinforcement and spreading."""

    recall: float = 0.15
    emotion: float = 0.2
    spread: float = 0.35
    trace: float = 0.18
    fast: float = 0.015
    slow: float = 0.002
    slow_share: float = 0.4
    threshold: float = 0.4
    edge_boost: float = 0.05
    prune: float = 0.05
    coactivation: float = 0.1
    coactivation_hours: float = 1.0
    context: float = 0.2
    context_decay: float = 0.02
    hop: float = 0.8
    least_hop: float = 0.1


SCORING, DYNAMICS = Scoring(), Dynamics()
SEGMENT_SIZE = 10_000
