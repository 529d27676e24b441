"""Landmark analytics as Spark jobs: points, paths, candidates, reviews and cell grids by case."""
