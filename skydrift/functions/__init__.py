from . import exprs, order, tails, vec  # noqa: F401
