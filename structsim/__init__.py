"""Structural similarity on Spark: feature bags, thresholded set-similarity joins, groups, baselines and reports."""
