"""Operators of a training-data pipeline over ``documents``, ``pages`` and ``embeddings``.

Nothing else in the library imports this subpackage.  Each module holds one operator with a
general interface; ``queries`` binds them to the registered ``opN_<name>`` queries.
"""
