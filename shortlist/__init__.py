"""Shortlist: find, screen and rank people profiles against job descriptions with Spark.

Every public function takes and returns DataFrames (or Columns); nothing runs until the
caller asks for an action, except where a docstring says that a table is written.
"""
