"""Options and the plan from reads to decompositions."""
