"""Training-data operators. Nothing outside this subpackage imports it.

Each module holds one operator with its own general interface; ``queries``
has the thin ``opN_<name>`` queries over the test tables and their SQL.
"""
