"""Errors raised by the engine."""


class GraphloomError(Exception):
    """Base of all errors."""


class FilterValidationError(GraphloomError):
    """A metadata filter is malformed."""


class SearchValidationError(GraphloomError):
    """Search parameters are missing or out of range."""


class QueryParseError(GraphloomError):
    """A full-text query string cannot be parsed."""


class GeneratedQueryError(GraphloomError):
    """A generated query is not a single read-only statement."""


class SchemaValidationError(GraphloomError):
    """A graph schema contradicts itself."""


class PromptError(GraphloomError):
    """A prompt template lacks a placeholder or an input."""


class PipelineDefinitionError(GraphloomError):
    """A pipeline has a cycle or an unknown component or parameter."""


class IndexExistsError(GraphloomError):
    """An index of that name is in the catalog."""
