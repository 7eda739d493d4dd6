"""Queries over the test tables."""

from utterloom.plans import corpus, exact, extras, manifests, scoring, signals, speech, talk, texts  # noqa: F401  they register themselves
