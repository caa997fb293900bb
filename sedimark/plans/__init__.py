"""Whole plans: analysis of a blob table, comparison of pairs, registered queries."""
