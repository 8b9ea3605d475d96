"""Training-data operators: each module holds one operator with its own general interface.

Nothing else in the package imports this folder; ``registry`` maps query names
to the operators applied to the driver's tables.
"""
