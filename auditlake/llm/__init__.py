"""Training-data operators over text tables.

Nothing outside this package imports it.  Each module holds one operator;
``queries`` registers the queries over the test tables.
"""
