"""All bound queries."""

from bindings import files, gaze, learning, trials, video  # noqa: F401
