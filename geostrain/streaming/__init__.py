"""No operator of this library needs a stream: all inputs are complete files.

Expressions of ``functions`` and the counts of ``operators.aggregates`` hold no
state of their own and work on a streaming DataFrame as they are.
"""
