from .graphs import edges_from_table, read_edge_list, vertices_of
from .layouts import read_layout, write_layout
from .trials import TRIALS, read_trials, write_trials

__all__ = [
    "TRIALS",
    "edges_from_table",
    "read_edge_list",
    "read_layout",
    "read_trials",
    "vertices_of",
    "write_layout",
    "write_trials",
]
