"""Local differential privacy on Spark DataFrames.

Sub-packages
------------
functions   column expressions: keyed uniforms, mechanisms, activations
operators   DataFrame-in, DataFrame-out operators
sources     tables, run-keyed stores, mechanism catalog
plans       whole jobs: privatise a dataset, compare models over a grid
streaming   the same privatisation on a streaming DataFrame
"""
