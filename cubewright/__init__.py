"""Dataset quality control as Spark jobs: inventories, tile metrics, observation cubes and report queries."""
