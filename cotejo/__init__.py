"""Table reconciliation and record refinement on PySpark DataFrames."""
