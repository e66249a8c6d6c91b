"""sparkloom: analytics and data processing on PySpark DataFrames."""
