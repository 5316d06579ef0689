"""Trial-based behavioural and eye-tracking data, reduced to participant scores on Spark.

Every operator takes a DataFrame and returns a lazy DataFrame.  ``functions`` holds
column builders, ``operators`` the relational steps, ``sources`` readers and writers,
``plans`` the complete task reductions.
"""

__version__ = "0.1.0"
