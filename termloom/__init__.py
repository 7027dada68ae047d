"""termloom: terminology mining as lazy DataFrame operators on Spark."""
