"""Errors of plans, mappings and sources; every one names what is wrong and where."""


class MappingError(Exception):
    """Base of all errors that the library raises itself."""


class PlanError(MappingError):
    """The plan document is not well formed: unknown fields, names, arities, cycles."""


class UnsupportedPlanError(PlanError):
    """The plan is well formed but asks for something that isn't there."""


class TemplateError(PlanError):
    """A template can't be parsed."""


class SourceError(MappingError):
    """A source can't be found or read."""


class SinkError(MappingError):
    """A target can't be written."""
