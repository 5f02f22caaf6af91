"""cohortlab: people-analytics and cohort-modelling operators on Spark DataFrames.

Every operator takes DataFrames and returns DataFrames.  Column names are
parameters (see :mod:`cohortlab.roles`); nothing is hard-coded to one table.
"""

from cohortlab.session import checkpoint_root, get_session

__all__ = ["checkpoint_root", "get_session"]
