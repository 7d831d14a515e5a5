"""cartolake: a data-context catalog engine on Spark DataFrames.

Every operator is a function from DataFrames (and plain parameters) to a
DataFrame.  Catalyst plans the work; nothing collects its main input.
"""

__version__ = "0.1.0"
