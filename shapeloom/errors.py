"""Errors raised by checks that need an answer before a job is planned."""


class LayoutError(ValueError):
    """The input tables do not describe a usable layout."""


class CapacityError(ValueError):
    """The planned expansion is larger than the caller allows."""


class ReconstructionError(ValueError):
    """Moved segments do not form legal contours."""
