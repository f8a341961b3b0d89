"""diurna: mobile-sensing analytics on Spark DataFrames.

Days run from 6AM to 6AM local time; every operator is a function from DataFrame to DataFrame.
"""
