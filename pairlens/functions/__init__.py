"""Column-to-column expressions; everything here stays inside the JVM."""

from pairlens.functions.labels import (
    config_label,
    display_name,
    format_p_value,
    network_of,
    parse_config,
    significance_stars,
    subject_key,
    title_label,
)
from pairlens.functions.vectors import (
    edge_ordinal,
    feature_set,
    fisher_z,
    nodes_of_edges,
    percent_difference,
    pool_vector,
    round6,
    soft_threshold,
)

__all__ = [
    "config_label",
    "display_name",
    "edge_ordinal",
    "feature_set",
    "fisher_z",
    "format_p_value",
    "network_of",
    "nodes_of_edges",
    "parse_config",
    "percent_difference",
    "pool_vector",
    "round6",
    "significance_stars",
    "soft_threshold",
    "subject_key",
    "title_label",
]
