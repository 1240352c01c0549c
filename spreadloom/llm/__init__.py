"""Training-data operators on Spark DataFrames.

One module per operator; ``queries`` holds the registered queries. Nothing else in the library imports this
subpackage.
"""
