"""Whole results from operators: each plan is one lazy DataFrame from sources to a contract table."""
