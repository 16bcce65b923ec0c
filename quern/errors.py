"""The one error type of the SQL surface."""

from __future__ import annotations

#: The codes that callers match on.
CODES = frozenset(
    """
    UnexpectedChar UnterminatedString InvalidNumber UnexpectedToken UnexpectedEof InvalidType TableNotFound
    ColumnNotFound WildcardInExpression TypeMismatch ColumnCountMismatch ArgCountMismatch NoDefaultValue
    UnknownFunction WrongArgCount InvalidViewDefinition TableAlreadyExists ViewAlreadyExists ViewNotFound
    TransactionAlreadyActive NoActiveTransaction ArgumentMismatch InvalidArgumentType PrimaryKeyConflict
    MultiplePrimaryKeys PrimaryKeyMustBeInteger UniqueViolation IndexAlreadyExists
    """.split()
)


class SqlError(Exception):
    def __init__(self, code: str, message: str = ""):
        assert code in CODES, code
        super().__init__(f"{code}: {message}" if message else code)
        self.code, self.message = code, message or code
