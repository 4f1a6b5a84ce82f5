"""Errors of the engine; ``tag`` names the kind for front ends, ``fields`` holds what it is about."""

from __future__ import annotations


class EngineError(Exception):
    tag = "EngineError"

    def __init__(self, message: str, **fields):
        super().__init__(message)
        self.message, self.fields = message, fields


def _error(tag: str, doc: str) -> type[EngineError]:
    return type(tag, (EngineError,), {"tag": tag, "__doc__": doc, "__module__": __name__})


NotFoundError = _error("NotFoundError", "No row has this id.")
DuplicateKeyError = _error("DuplicateKeyError", "The id is taken.")
ForeignKeyError = _error("ForeignKeyError", "A reference has no target, or a target is still referred to.")
ValidationError = _error("ValidationError", "Rows or arguments don't fit the schema; fields: issues.")
UniqueConstraintError = _error("UniqueConstraintError", "A unique key is taken.")
ConcurrencyError = _error("ConcurrencyError", "Another writer has published a version meanwhile.")
OperationError = _error("OperationError", "The collection doesn't allow the operation.")
TransactionError = _error("TransactionError", "The transaction is closed, or another one is open.")
HookError = _error("HookError", "A hook rejected the rows.")
DanglingReferenceError = _error("DanglingReferenceError", "A populated reference has no target.")
CollectionNotFoundError = _error("CollectionNotFoundError", "There is no such collection.")
PopulationError = _error("PopulationError", "A relation can't be populated.")
StorageError = _error("StorageError", "Files can't be read or written.")
SerializationError = _error("SerializationError", "A text can't be parsed or written in its format.")
UnsupportedFormatError = _error("UnsupportedFormatError", "No codec has this format.")
MigrationError = _error("MigrationError", "A chain of migrations is invalid, or a step failed.")
PluginError = _error("PluginError", "A plugin is invalid.")
