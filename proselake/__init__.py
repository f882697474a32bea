"""proselake: measuring and preparing prose at corpus scale on Spark DataFrames."""
