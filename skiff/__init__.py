"""skiff: an ordered, pandas-shaped analytics layer whose operations only build Spark plans."""
