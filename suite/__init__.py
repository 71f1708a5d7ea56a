"""Registered queries: every operator on the given tables, with its SQL twin."""

from suite.common import ORACLES, QUERIES


def load_all() -> None:
    from suite import (  # noqa: F401
        binning,
        encoders,
        folds,
        joins,
        ledger,
        metrics,
        models,
        probability,
        rowwise,
        search,
        sources,
        stats,
        streams,
    )


__all__ = ["ORACLES", "QUERIES", "load_all"]
