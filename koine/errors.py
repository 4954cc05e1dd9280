"""Errors of the rule engine."""


class EngineError(Exception):
    """Base of all errors raised by the engine."""


class ForeignIdError(EngineError):
    """An id of one database was used with another."""


class ArityError(EngineError):
    """A map got another number of arguments than its signature has."""


class TypeMismatchError(EngineError):
    """A term of one type stands where another is declared."""


class UnboundVariableError(EngineError):
    """An action uses a variable that no pattern binds."""


class CollisionError(EngineError):
    """Two keys or two terms have the same hash."""


class GrammarError(EngineError):
    """Text that is no rule, rewrite, equivalence, term or signature."""
