"""Entity-mart analytics as plain PySpark: star views, pivots, search, rules, resolution, cost."""
