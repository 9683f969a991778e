"""Relational operators: paired experiments, resampling, ROC, matching, graphs, retrieval and roll-ups."""
