"""Readers, writers and generators of samples, graphs and densities."""

from .tables import embedding_signs, lineitem_codes, order_codes
from .text import (
    generate_samples,
    line_count,
    log_density_lines,
    number_lines,
    numbered_lines,
    read_adjacency,
    read_densities,
    read_edge_list,
    read_indexed_densities,
    read_indexed_observations,
    read_observations,
    read_variables,
    repeat_columns,
    repeat_rows,
    to_adjacency,
    to_int_list,
    write_lines,
)

__all__ = [
    "embedding_signs",
    "generate_samples",
    "line_count",
    "lineitem_codes",
    "log_density_lines",
    "number_lines",
    "numbered_lines",
    "order_codes",
    "read_adjacency",
    "read_densities",
    "read_edge_list",
    "read_indexed_densities",
    "read_indexed_observations",
    "read_observations",
    "read_variables",
    "repeat_columns",
    "repeat_rows",
    "to_adjacency",
    "to_int_list",
    "write_lines",
]
