"""Churn analytics: feature table, preprocessing, forest training/scoring, risk metrics."""
