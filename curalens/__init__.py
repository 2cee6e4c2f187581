"""curalens: task-store queries, evaluation roll-ups and data curation on Spark DataFrames."""
