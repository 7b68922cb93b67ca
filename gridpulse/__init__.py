"""gridpulse: outage analytics and corpus preparation on Spark DataFrames."""
