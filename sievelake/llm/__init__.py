"""Operators for preparing large text corpora for model training.

Every operator is a function from DataFrames to DataFrames in a module of its
own; ``queries`` binds them to the tables of a data folder. Nothing outside
this subpackage imports it.
"""
