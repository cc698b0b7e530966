"""Two-sided site comparison as Spark jobs: snapshots in, findings and statistics out."""
