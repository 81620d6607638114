"""Naming an intermediate value inside one SQL expression."""


def let(value: str, name: str, body: str) -> str:
    """SQL for ``body`` with ``name`` standing for ``value``, which is evaluated once.

    Expressions are trees: writing a sub-expression twice copies it, and copies of copies
    grow without bound. A lambda variable keeps the tree small.
    """
    return f"get(transform(array({value}), {name} -> {body}), 0)"
