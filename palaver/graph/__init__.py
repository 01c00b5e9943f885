"""Graph operators on edge DataFrames."""
