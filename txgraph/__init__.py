"""txgraph: transaction-graph analytics as Spark DataFrame plans.

The public surface: free functions over ``edges(src, dst, value)`` /
``vertices(id, ...)`` DataFrames, grouped by module, re-exported here.
"""

from txgraph.functions import hex_quantity, hex_to_long, long_to_hex, strip_0x
from txgraph.operators.build import (TxGraph, assign_ids, build_graph, encode_edges,
                                     graph_counts, induced_edges, induced_subgraph)
from txgraph.operators.clustering import (average_clustering,
                                          global_clustering, local_clustering, local_split,
                                          transitivity)
from txgraph.operators.community import (cluster_count, cluster_links, cluster_sizes,
                                         label_propagation, modularity)
from txgraph.operators.components import (component_sizes, connected_components,
                                          greatest_components, top_components)
from txgraph.operators.degrees import degree_filter, degree_filter_graph, degrees, possible_triplets
from txgraph.operators.sample import (block_range_sample, dedup_last_wins, node_table,
                                      snowball_sample)
from txgraph.operators.triangles import (triangle_count, triangle_total, triangles,
                                         vertex_triangles)
from txgraph.operators.views import (directed_edges, drop_self_loops, merge_parallel,
                                     neighbours, simple_edges)
from txgraph.plans.report import graph_report
from txgraph.sources.blocks import (ingest_address_refs, ingest_block_txids, ingest_blocks,
                                    ingest_tx_edges, parse_json, read_json)
from txgraph.sources.csv import read_edges, read_vertices, write_graph_csv, write_rows
from txgraph.sources.gexf import gexf_lines, write_gexf
from txgraph.streaming.blocks import block_stream, stream_blocks

__all__ = [
    "TxGraph", "assign_ids", "average_clustering", "block_range_sample", "block_stream",
    "build_graph", "cluster_count", "cluster_links", "cluster_sizes",
    "component_sizes", "connected_components", "dedup_last_wins", "degree_filter",
    "degree_filter_graph", "degrees", "directed_edges", "drop_self_loops", "encode_edges",
    "gexf_lines", "global_clustering", "graph_counts", "graph_report", "greatest_components",
    "hex_quantity", "hex_to_long", "induced_edges", "induced_subgraph", "ingest_address_refs",
    "ingest_block_txids", "ingest_blocks", "ingest_tx_edges", "label_propagation",
    "local_clustering", "local_split", "long_to_hex", "merge_parallel", "modularity",
    "neighbours", "node_table", "parse_json", "possible_triplets", "read_edges", "read_json",
    "read_vertices", "simple_edges", "snowball_sample", "stream_blocks", "strip_0x",
    "top_components", "transitivity", "triangle_count", "triangle_total", "triangles",
    "vertex_triangles", "write_gexf", "write_graph_csv", "write_rows",
]
