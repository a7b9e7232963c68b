"""citewell: bibliometric indicator cubes and corpus preparation on Apache Spark."""
