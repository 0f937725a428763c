"""Whole lifecycles: learn a tree, answer evidence, build mixtures, time methods, draw."""

from .lifecycle import Learned, answer, compare_methods, kl_by_trees, learn_tree, time_methods, time_mixtures
from .present import to_dot

__all__ = ["Learned", "answer", "compare_methods", "kl_by_trees", "learn_tree", "time_methods", "time_mixtures", "to_dot"]
