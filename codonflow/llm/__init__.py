"""Operators for training-data pipelines over large text corpora; nothing else in the package imports this one."""
