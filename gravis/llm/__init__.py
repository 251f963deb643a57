"""Training-data operators (numbered 1 to 13) and their registered queries.

Nothing else in the library imports this subpackage; ``gravis.llm.catalogue``
lists its queries and oracle texts.
"""
