"""Diagnostics of the language and the algebra; the name says what is wrong."""


class SetwiseError(Exception):
    """Base of all errors that a query's author can cause."""


class ParseError(SetwiseError):
    pass


class CompileError(SetwiseError):
    pass


def _kind(name: str, doc: str) -> type[CompileError]:
    return type(name, (CompileError,), {"__doc__": doc})


UndefinedFunction = _kind("UndefinedFunction", "A name that is bound nowhere.")
UndefinedTicVariable = _kind("UndefinedTicVariable", "A tic variable outside its solve.")
MultiplyDefinedTicVariable = _kind("MultiplyDefinedTicVariable", "A tic variable that a solve names twice.")
OperationOnUnrelatedSets = _kind("OperationOnUnrelatedSets", "Sets without common identities, and no relate that crosses them.")
UnionProvenanceDifferentLength = _kind("UnionProvenanceDifferentLength", "Union of sets with different numbers of identities.")
IntersectProvenanceDifferentLength = _kind("IntersectProvenanceDifferentLength", "Intersection of sets with different numbers of identities.")
DifferenceProvenanceDifferentLength = _kind("DifferenceProvenanceDifferentLength", "Difference of sets with different numbers of identities.")
CondProvenanceDifferentLength = _kind("CondProvenanceDifferentLength", "Branches with different numbers of identities.")
IntersectWithNoCommonalities = _kind("IntersectWithNoCommonalities", "An intersection that can only be empty.")
DifferenceWithNoCommonalities = _kind("DifferenceWithNoCommonalities", "A difference that can only be its whole left side.")
AlreadyRelatedSets = _kind("AlreadyRelatedSets", "A relate of sets that have common identities anyway.")
IncorrectArity = _kind("IncorrectArity", "A function with the wrong number of arguments.")
SolveLackingFreeVariables = _kind("SolveLackingFreeVariables", "A solve that names no variable.")
UnableToSolveTicVariable = _kind("UnableToSolveTicVariable", "A variable that no equality of the body determines.")
ConstraintsWithinInnerSolve = _kind("ConstraintsWithinInnerSolve", "An inner solve that constrains an outer variable.")
CannotUseDistributionWithoutSampling = _kind("CannotUseDistributionWithoutSampling", "A distribution that is not observed.")


class AssertionFailed(SetwiseError):
    """An assert whose condition did not hold, or was empty."""


class EnormousCross(SetwiseError):
    """A cross of more rows than permitted."""


class QueryTimeout(SetwiseError):
    """A query that took longer than it may."""
