"""Site-audit analytics and corpus data processing on PySpark DataFrames."""
