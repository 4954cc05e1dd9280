"""Rules over uninterpreted terms with built-in equality, on Spark DataFrames."""

from koine.database import Database
from koine.domain import Domain
from koine.errors import ArityError, CollisionError, EngineError, ForeignIdError, GrammarError, TypeMismatchError, UnboundVariableError
from koine.functions.ids import MapId, MapSignature, TermId, TypeId
from koine.plans.ast import Apply, Rule, Union, Var, equivalence, rewrite
from koine.plans.parse import parse_equivalence, parse_rewrite, parse_rule, parse_signature, parse_term

__all__ = [
    "Apply", "ArityError", "CollisionError", "Database", "Domain", "EngineError", "ForeignIdError", "GrammarError", "MapId", "MapSignature", "Rule", "TermId", "TypeId",
    "TypeMismatchError", "UnboundVariableError", "Union", "Var", "equivalence", "parse_equivalence", "parse_rewrite", "parse_rule", "parse_signature",
    "parse_term", "rewrite",
]
