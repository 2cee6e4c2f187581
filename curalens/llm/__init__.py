"""Training-data operators: scoring, near-duplicates, WARC, extraction, packing."""

import os

# small matrices are slower on many threads, and Spark already runs a task on each core
os.environ.setdefault("OMP_NUM_THREADS", "1")
