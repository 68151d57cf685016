"""Tunables, policy predicates and small numeric rules shared by the operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Tunables:
    """Fixed default values; pass another instance to an operator to change them."""

    sibling_rank_weight: float = 0.3
    priming_alpha: float = 0.5
    priming_window_min: int = 120
    similar_limit: int = 5
    expand_hops: int = 1
    strengthen_step: float = 1.0
    decay_factor: float = 0.9
    prune_floor: float = 0.3
    neighbor_floor: float = 0.5
    proposed_initial_weight: float = 0.35
    rebirth_related_boost: float = 0.1
    rebirth_search_boost: float = 0.05
    missing_edge_vec_cos: float = 0.9
    missing_edge_bm25: float = -70.0
    window_gap_sec: int = 900
    cluster_max_size: int = 12
    split_min_words: int = 400
    split_min_sections: int = 4
    split_min_tag_diversity: int = 3
    eager_max_count: int = 20
    disagree_floor: float = 0.15
    model_alarm_rate: float = 0.4
    roundtrip_topk: int = 10
    idf_df_ceiling: float = 0.25
    events_retention_days: int = 30
    lifecycle_retention_days: int = 180
    habituation_growth: float = 1.5
    habituation_words: float = 0.5
    habituation_sections: float = 2.0
    homeostasis_min_sample: int = 50
    homeostasis_low: float = 0.02
    homeostasis_high: float = 0.15
    oversized_words: int = 2000


#: Tunables that may change over time: wild value, least, most, whether it may be set, whether it is whole; fixed values.
GENES = {
    "sibling_rank_weight": (0.3, 0.0, 1.0, True, False), "priming_alpha": (0.5, 0.0, 2.0, True, False), "priming_window_min": (120.0, 10.0, 1440.0, True, True), "similar_limit": (5.0, 2.0, 12.0, True, True),
    "expand_hops": (1.0, 0.0, 2.0, True, True), "strengthen_step": (1.0, 0.1, 2.0, False, False), "decay_factor": (0.9, 0.5, 0.99, False, False), "prune_floor": (0.3, 0.05, 0.5, False, False),
    "neighbor_floor": (0.5, 0.1, 1.0, False, False), "proposed_initial_weight": (0.35, 0.1, 0.6, False, False), "rebirth_default_factor": (1.1, 1.0, 1.3, False, False), "rebirth_related_boost": (0.1, 0.0, 0.3, False, False),
    "rebirth_search_boost": (0.05, 0.0, 0.3, False, False), "missing_edge_vec_cos": (0.9, 0.5, 0.99, False, False), "missing_edge_bm25": (-70.0, -200.0, -10.0, False, False), "window_gap_sec": (900.0, 60.0, 7200.0, False, True),
}

#: Edge kinds that are stored with src < dst, and those that use changes.
UNDIRECTED = ("cooccur", "assoc", "sibling")
LEARNED = ("cooccur", "assoc")


def fresh() -> Column:
    return ~F.coalesce(F.col("stale"), F.lit(False))


def not_eager() -> Column:
    return F.col("priority") != "eager"


def forgettable() -> Column:
    """Neither a template's note nor locked."""
    return F.col("template").isNull() & ~F.col("locked")


def decay_candidate() -> Column:
    return fresh() & not_eager() & forgettable()


def rank_weight(t: Tunables) -> Column:
    return F.col("weight") * F.when(F.col("kind") == "sibling", t.sibling_rank_weight).otherwise(1.0)


def rounded(x: Column, digits: int = 6) -> Column:
    """Half up, by the same arithmetic in every engine."""
    return F.floor(x * 10**digits + 0.5) / 10**digits
