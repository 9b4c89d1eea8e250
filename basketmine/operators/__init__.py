"""Mining operators: preparation, candidates, support, rules, recommendations."""
