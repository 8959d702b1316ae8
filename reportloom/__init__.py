"""Sales, commission and rebate report analytics on Spark DataFrames."""
