"""Errors that the scalar helpers raise; tables carry a note instead."""


class RankError(Exception):
    """Base of all."""


class BadInput(RankError, ValueError):
    """Missing, infinite or mistyped values, unknown columns or options."""


class UndefinedMeasure(RankError, ValueError):
    """A target without variation has no ranking to measure."""


class TooFewRows(RankError, ValueError):
    """Fewer rows than the estimate needs."""


class BadScorer(RankError, TypeError):
    """Something that gives no score for a row."""
