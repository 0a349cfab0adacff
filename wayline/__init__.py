"""Access-route analytics as Spark DataFrame plans.

A *route* says which client reached which database and schema, through which
warehouse, in which direction, and in how many distinct queries.  The package
builds routes from three audit logs and derives roll-ups, graphs, flows and
matrices from them.  Everything takes DataFrames and returns DataFrames.
"""

from wayline.context import JobContext

__all__ = ["JobContext"]
