"""The operators bound to the star-schema test tables, with equivalent SQL."""

from structscreen.bindings.core import REGISTRY


def load():
    from structscreen.bindings import files, points, poses, predictions, sequences, text_records, whole  # noqa: F401

    return REGISTRY
