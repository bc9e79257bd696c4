"""Training-data operators: one module per operator, thin contract queries in ``queries``.

Nothing else in the library imports this subpackage.
"""
