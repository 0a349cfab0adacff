"""Column expressions.  All are built from native Spark functions."""

from wayline.functions.badges import abbreviation, badge_uri, hue
from wayline.functions.direction import access_mode, statement_direction
from wayline.functions.layers import DEFAULT_LAYERS, layer_of
from wayline.functions.names import (
    database_of, feature_label, qualified_schema_of, short_schema,
)
from wayline.functions.scale import log_scale, node_size
from wayline.functions.text import edge_text, node_text, thousands

__all__ = [
    "DEFAULT_LAYERS", "abbreviation", "access_mode", "badge_uri", "database_of",
    "edge_text", "feature_label", "hue", "layer_of", "log_scale", "node_size",
    "node_text", "qualified_schema_of", "short_schema", "statement_direction",
    "thousands",
]
