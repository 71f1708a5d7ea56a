"""Operators of a training-data pipeline; nothing else in the library imports this package.

``load_all`` imports the modules, each of which registers its query.
"""

from pyspark import cloudpickle

from sparktab.llm.common import ORACLES, QUERIES

# Worker functions travel whole, so executors need no copy of this package.
import sparktab.llm as _package  # noqa: E402

cloudpickle.register_pickle_by_value(_package)


def load_all() -> None:
    from sparktab.llm import (  # noqa: F401
        alignment,
        ann,
        bpe,
        decontaminate,
        idfiles,
        licenses,
        quality,
        shards,
        similar,
        spellings,
        suffixes,
        urls,
        warc,
    )


__all__ = ["ORACLES", "QUERIES", "load_all"]
