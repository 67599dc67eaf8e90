"""Operators over cells and times: each takes DataFrames and returns one."""
