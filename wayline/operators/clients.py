"""Attributes of client names for drawing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.functions.badges import abbreviation, badge_uri, hue
from wayline.functions.names import feature_label


def feature_names(routes: DataFrame, feature_prefix: str) -> DataFrame:
    """``client``: the names that features get once they are shown under their own."""
    label = F.col("CLIENT")
    return routes.filter(label.startswith(feature_prefix)).select(
        feature_label(label, feature_prefix).alias("client")
    ).filter(F.col("client").isNotNull()).distinct()


def client_attributes(clients: DataFrame, listed: DataFrame | None = None,
                      family_prefix: str | None = None,
                      features: DataFrame | None = None) -> DataFrame:
    """``client, abbreviation, hue, icon, badge`` for each distinct ``client``.

    ``listed`` (client, abbreviation, icon) overrides what is made from the
    name.  A client that is not listed and starts with ``family_prefix``, or is
    one of ``features`` (see :func:`feature_names`), takes the icon listed
    under that prefix.  How the tables are joined is left to their sizes.
    """
    names = clients.select("client").filter(F.col("client").isNotNull()).distinct()
    if listed is None:
        named = names.select("client", F.lit(None).cast("string").alias("_short"),
                             F.lit(None).cast("string").alias("icon"))
    else:
        own = listed.select("client", F.col("abbreviation").alias("_short"), F.col("icon"))
        named = names.join(own, "client", "left")
        if family_prefix:
            family = listed.filter(F.col("client") == family_prefix).select(
                F.col("client").alias("_family"), F.col("icon").alias("_icon"))
            member = F.col("client").startswith(family_prefix)
            if features is not None:
                marked = features.select("client", F.lit(True).alias("_feature")).distinct()
                named = named.join(marked, "client", "left")
                member = member | F.coalesce("_feature", F.lit(False))
            named = named.withColumn("_family", F.when(member, F.lit(family_prefix))).join(
                family, "_family", "left").withColumn("icon", F.coalesce("icon", "_icon"))
    client = F.col("client")
    marked = named.select("client", abbreviation(client, F.col("_short")).alias("abbreviation"),
                          hue(client).alias("hue"), "icon")
    return marked.withColumn("badge", badge_uri(F.col("hue"), F.col("abbreviation")))
