"""The errors that this package raises for its own reasons."""

from __future__ import annotations


class CreaseError(Exception):
    """Base of all errors of the package."""


class ConfigurationError(CreaseError):
    """A configuration file is missing, cannot be read, or lacks a needed member."""


class SourceError(CreaseError):
    """A source file is absent, damaged, or would be overwritten."""


class ContractError(CreaseError):
    """A table does not have the columns or values that its contract asks for."""


class QualityError(CreaseError):
    """A quality check of the data failed."""


class LeakageError(QualityError):
    """Rows of the future, or of the target, are among the features."""


class LookupMissing(CreaseError):
    """A lookup that must find every key did not, or its keys are not unique."""
