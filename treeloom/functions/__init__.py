"""Scalar expressions."""

from .scalars import add_maps, concat_array_maps, divide_maps, hash_uniform, multiply_maps, truncate_at

__all__ = ["add_maps", "concat_array_maps", "divide_maps", "hash_uniform", "multiply_maps", "truncate_at"]
