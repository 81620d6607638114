"""DNS query-log abuse analytics as Spark jobs.

Every job takes DataFrames plus an explicit evaluation time and returns DataFrames;
nothing is pulled to the driver and no job reads the wall clock.
"""

from tidewarden.params import Params

__all__ = ["Params"]
