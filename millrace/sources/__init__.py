"""Readers and writers."""

from millrace.sources.cells import CellTable
from millrace.sources.lines import with_lines
from millrace.sources.readers import TPCH, in_neighbours, out_degrees, read_delimited, read_edges, read_graph, read_keyed, read_lines, read_similarity, read_similarity_records, read_table
from millrace.sources.writers import cells_of_groups, cells_of_join, cells_of_rows, edge_headers, hash_partition, rank_lines, distance_lines, similarity_lines, wide_cells, write_edges, write_lines, write_pairs, write_similarity, write_table, write_vertices

__all__ = ["CellTable", "TPCH", "cells_of_groups", "cells_of_join", "cells_of_rows", "distance_lines", "edge_headers", "hash_partition", "in_neighbours", "out_degrees", "rank_lines", "read_delimited", "read_edges", "read_graph", "read_keyed", "read_lines", "read_similarity", "read_similarity_records", "read_table", "similarity_lines", "wide_cells", "with_lines", "write_edges", "write_lines", "write_pairs", "write_similarity", "write_table", "write_vertices"]
