"""Training-data operators: one module per operator, `queries` ties them to the test tables.

Nothing outside this subpackage imports it.
"""
