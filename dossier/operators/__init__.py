"""Operators on DataFrames: blocks, cards, evidence, layout, comparison, rules, export."""
