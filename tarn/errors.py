"""Errors; the lookup errors are also ValueErrors."""


class LakeError(Exception):
    pass


class TableNotFoundError(LakeError, ValueError):
    pass


class SchemaNotFoundError(LakeError, ValueError):
    pass


class CatalogVersionError(LakeError, ValueError):
    pass


class UnsupportedUnionTypeError(LakeError, TypeError):
    """A column of values of several types."""


class TransactionConflictError(LakeError):
    """Another transaction has changed the table in a way that this one cannot follow."""
