"""Voxel volumes, surface meshes and segment catalogues as Spark DataFrames."""
