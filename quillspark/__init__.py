"""An analytics engine for table comparison, guarded SQL, profiling and schema work on Spark."""
