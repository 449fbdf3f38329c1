"""Training-data operators: independent DataFrame operators and their registered queries.

Nothing outside this folder imports it. Each module holds one operator with its own general interface;
``queries`` holds the thin ``opN_<name>`` queries that derive the contract columns from the operators.
"""
