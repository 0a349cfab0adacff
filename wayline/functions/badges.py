"""Letter badges for client names: abbreviation, colour and image."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayline.functions.text import filled

# Fixed value: the badge image.  {hue} and {letters} are filled in per client.
BADGE_SVG = (
    '<svg xmlns="http://www.w3.org/2000/svg" width="128" height="128" viewBox="0 0 128 128">'
    '<circle cx="64" cy="64" r="60" fill="hsl({hue}, 55%, 50%)" stroke="white" stroke-width="3"/>'
    '<text x="64" y="64" text-anchor="middle" dominant-baseline="central" '
    'font-family="Arial, -apple-system, BlinkMacSystemFont, sans-serif" '
    'font-weight="700" font-size="48" fill="white">{letters}</text></svg>'
)
URI_PREFIX = "data:image/svg+xml;base64,"


def hue(name: Column) -> Column:
    """Colour angle 0–359, the same for the same name everywhere."""
    return (F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("bigint") % 360).cast("int")


def abbreviation(name: Column, listed: Column | None = None) -> Column:
    """Two letters for a name; ``listed`` wins where it is not NULL."""
    clean = F.regexp_replace(name, "[/ ]", "")
    rest = F.substring(clean, 2, 2147483647)
    next_mark = F.regexp_extract(rest, r"[\p{Lu}\p{Nd}]", 0)
    second = F.when(next_mark != "", next_mark).otherwise(F.lower(F.substring(clean, 2, 1)))
    made = F.when(F.length(clean) <= 2, F.upper(clean)).otherwise(
        F.substring(F.concat(F.upper(F.substring(clean, 1, 1)), second), 1, 2)
    )
    return made if listed is None else F.coalesce(listed, made)


def badge_uri(hue_col: Column, letters: Column) -> Column:
    """Badge as a data URI.  Spark's base64 wraps its lines, so they are joined."""
    svg = filled(BADGE_SVG, hue=hue_col, letters=letters)
    return F.concat(
        F.lit(URI_PREFIX), F.regexp_replace(F.base64(F.encode(svg, "UTF-8")), r"[\r\n]", "")
    )
