"""Order-to-cash analytics as Spark DataFrame operators.

Every operator takes DataFrames and returns a DataFrame; nothing is collected
to the driver and no Python code runs per row.
"""

__version__ = "0.1.0"
