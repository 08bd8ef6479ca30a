"""Splits, metrics, training, selection and scoring."""
