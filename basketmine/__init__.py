"""basketmine: frequent itemsets, association rules and recommendations on Spark."""

from .operators.candidates import generate_candidates, prune_candidates, union_generators
from .operators.containment import count_support, held_sets, holders_of, retain_baskets
from .operators.fpgrowth import fpgrowth_itemsets
from .operators.pairs import SkewPolicy, pair_join
from .operators.prepare import (baskets, bounded_ratings, count_users, distinct_user_count,
                                frequent_items, item_support)
from .operators.recommend import recommend
from .operators.rules import association_rules, filter_rules, with_rule_text
from .operators.support import (candidate_support, iteration_stats, retained_baskets,
                                retained_users)
from .plans.miner import Level, MiningResult, mine
from .plans.run import run
from .plans.runtime import free_scratch, scratch_scope, session

__all__ = [
    "Level", "MiningResult", "SkewPolicy", "association_rules", "baskets", "bounded_ratings",
    "candidate_support", "count_support", "count_users", "distinct_user_count",
    "filter_rules", "fpgrowth_itemsets", "free_scratch", "frequent_items", "generate_candidates", "held_sets",
    "holders_of", "item_support", "iteration_stats", "mine", "pair_join", "prune_candidates",
    "recommend", "retain_baskets", "retained_baskets", "retained_users", "run", "scratch_scope", "session", "union_generators", "with_rule_text",
]
