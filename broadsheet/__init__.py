"""broadsheet: batch jobs that build and study news-digest editions on Spark.

Every public function takes and returns DataFrames or Columns. Nothing is
collected to the driver; "now" is a column (``as_of``) and every per-run limit
is a per-edition limit, so one run handles many editions at once.
"""

__all__ = ["session"]
