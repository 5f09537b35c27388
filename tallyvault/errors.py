"""What a request is refused with; `code` is stable."""

from __future__ import annotations


class Refused(ValueError):
    code = "REFUSED"

    def __init__(self, message: str, code: str | None = None):
        super().__init__(message)
        self.code = code or self.code

    def body(self) -> dict:
        return {"code": self.code, "message": str(self), "details": None}


class InvalidFilter(Refused):
    code = "INVALID_FILTER"


class NotFound(Refused):
    code = "NOT_FOUND"


class InvalidInventory(Refused):
    code = "INVALID_INVENTORY"


class InvalidScenario(Refused):
    code = "INVALID_SCENARIO"
