"""The one exception of the engine: a code for programs, a message for people, and details."""

from __future__ import annotations


class EngineError(Exception):
    def __init__(self, code: str, message: str, **details):
        super().__init__(f"{code}: {message}")
        self.code, self.details = code, details
