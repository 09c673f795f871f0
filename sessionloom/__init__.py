"""Working context of many agent sessions as Spark jobs: token counts, scores, pressure, compaction plans, working sets."""
