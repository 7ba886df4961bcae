"""Flaky-CI analytics as Spark DataFrame operators.

Every public function takes and returns lazy DataFrames (or Columns), so the
whole path from job rows and step logs to a ranked report is one Catalyst plan.
"""
