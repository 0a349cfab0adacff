"""Texts with values filled in: summaries of nodes and edges."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

# The summaries of nodes, their neighbours and edges.
NODE_SUMMARY = """\
{kind}: {node}
Organization: {org}
Account: {account}
───────────────────
Total Access: {total}
  Read:  {read}
  Write: {write}
───────────────────
Top Connections:"""
NEIGHBOUR_LINE = "  {name}: {weight}"
EDGE_SUMMARY = """\
{src} {arrow} {dst}
Direction: {mode}
Access Count: {value}"""
ONE_WAY, BOTH_WAYS = "→", "↔"


def filled(template: str, **values: Column) -> Column:
    """The template with each ``{name}`` replaced by a column; NULL leaves nothing."""
    parts = []
    for text, name, _, _ in Formatter().parse(template):
        if text:
            parts.append(F.lit(text))
        if name:
            parts.append(F.coalesce(values[name].cast("string"), F.lit("")))
    return F.concat(*parts)


def thousands(number: Column) -> Column:
    """Whole number with a comma every three digits."""
    return F.format_number(number, 0)


def neighbour_line(name: Column, weight: Column) -> Column:
    return filled(NEIGHBOUR_LINE, name=name, weight=thousands(weight))


def node_text(kind: Column, node: Column, org: Column, account: Column,
              total: Column, read: Column, write: Column, *neighbours: Column) -> Column:
    """Multi-line summary; absent neighbours leave no line behind."""
    head = filled(NODE_SUMMARY, kind=kind, node=node, org=org, account=account,
                  total=thousands(total), read=thousands(read), write=thousands(write))
    return F.rtrim(F.concat_ws("\n", head, *neighbours))


def edge_text(src: Column, dst: Column, mode: Column, value: Column) -> Column:
    """Ends, mode and count; a combined edge points both ways."""
    arrow = F.when(mode == "ALL", BOTH_WAYS).otherwise(ONE_WAY)
    return filled(EDGE_SUMMARY, src=src, arrow=arrow, dst=dst, mode=mode, value=thousands(value))
