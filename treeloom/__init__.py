"""Treeloom: a PySpark engine for collections of documents made of ordered parts that refer to one another."""

import importlib

__version__ = "0.2.0"

#: Public names by module; each is imported when it is first asked for.
_PUBLIC = {
    "treeloom.session": ("NotConverged", "begin_run", "build_session", "clear", "ship"),
    "treeloom.sources.readers": ("load_settings", "read_assignments", "read_pool", "read_records", "read_results", "read_shards"),
    "treeloom.sources.arrays": ("npz_keys", "read_features", "read_matrix", "read_predictions", "save_archives"),
    "treeloom.sources.sinks": ("checksums", "manifest", "save_clusterings", "save_final", "save_json", "save_predictions", "save_vectors"),
    "treeloom.operators.records": ("RecordError", "claim_depths", "evaluation_records", "graph_validation", "normalize_records", "read_legacy"),
    "treeloom.operators.hierarchy": ("cyclic_nodes", "forest_summary", "node_depths", "peel_edges", "peel_nested", "peeled_descendants"),
    "treeloom.operators.pooling": ("Pooling", "part_vectors", "pool", "pool_grid", "record_depths"),
    "treeloom.operators.reduction": ("Reduction", "fit", "transform"),
    "treeloom.operators.kmeans": ("KMeansResult", "run_seeds", "spherical_kmeans"),
    "treeloom.operators.metrics": ("by_level", "label_match", "scores", "seed_summary"),
    "treeloom.operators.checks": ("align_positions", "alignment", "compare_matrices", "join_strict", "quantile"),
    "treeloom.streaming.accumulate": ("accumulate_stream", "finalize", "stream_windows"),
}
_MODULE_OF = {name: module for module, names in _PUBLIC.items() for name in names}
__all__ = sorted(_MODULE_OF)


def __getattr__(name: str) -> object:
    if name not in _MODULE_OF:
        raise AttributeError(name)
    return getattr(importlib.import_module(_MODULE_OF[name]), name)
