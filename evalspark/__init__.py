"""evalspark: judging machine-written SQL, and the clinical-style queries it answers, as Spark jobs.

Every operator takes DataFrames (or Columns) and returns DataFrames (or
Columns); nothing is collected inside an operator.  See README.md for the map
from operator ids to functions.
"""
