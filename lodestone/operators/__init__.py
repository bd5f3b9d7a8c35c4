"""The engine's operators over DataFrames."""
