"""Errors of statements."""


class StatementError(ValueError):
    """A statement that can't be read or isn't supported."""


class SyntaxProblem(StatementError):
    """Unreadable text, with the place it was noticed."""

    def __init__(self, message: str, line: int, column: int):
        super().__init__(f"{message} - [Start: Line {line}, Col: {column}]")
        self.line, self.column = line, column


class TableDoesNotExistError(StatementError):
    def __init__(self, table: str):
        super().__init__(f"Table does not exist: {table}")
        self.table = table


class ColumnDoesNotExistError(StatementError):
    def __init__(self, column: str, table: str = ""):
        super().__init__(f"Column does not exist: {column}" + (f" in {table}" if table else ""))
        self.column, self.table = column, table
