"""Whole plans: the decision rule, models, the end-to-end pipeline, registered queries and their SQL."""
