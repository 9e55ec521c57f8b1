"""Quality gates, ordered computations, folds, evaluation and the daily cycle."""
