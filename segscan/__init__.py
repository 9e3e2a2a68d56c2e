"""segscan: copy-number segment analytics and table-scale data preparation on Spark."""
