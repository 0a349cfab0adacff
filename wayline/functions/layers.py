"""Which layer of the warehouse a database belongs to, told by its name."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

LayerRules = Sequence[tuple[str, Callable[[Column], Column]]]

# Default layer names and the database names they cover.
DEFAULT_LAYERS: LayerRules = (
    ("Raw Layer", lambda name: name.startswith("RAW_")),
    ("Clean Layer", lambda name: name.startswith("CLEANED_") | (name == "INTEGRATED_DB")),
    ("Gold Layer", lambda name: name.endswith("_MART_DB")),
)


def layer_of(name: Column, layers: LayerRules = DEFAULT_LAYERS) -> Column:
    """Label of the first rule that holds, or the empty string."""
    label = F.lit("")
    for title, holds in reversed(layers):
        label = F.when(holds(name), title).otherwise(label)
    return label
