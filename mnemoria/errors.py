"""Errors with a code, a context and advice, so that callers can act on them."""

from __future__ import annotations


class MnemoriaError(Exception):
    code = "ERROR"
    recoverable = True

    def __init__(self, message: str, *, code: str | None = None, suggestions: tuple[str, ...] = (), **context):
        super().__init__(message)
        self.message, self.context, self.suggestions = message, context, suggestions
        if code:
            self.code = code

    def to_dict(self) -> dict:
        return {"error": type(self).__name__, "code": self.code, "message": self.message, "context": self.context, "recoverable": self.recoverable, "suggestions": list(self.suggestions)}


def _kind(name: str, code: str, recoverable: bool = True) -> type[MnemoriaError]:
    return type(name, (MnemoriaError,), {"code": code, "recoverable": recoverable, "__module__": __name__})


ConfigurationError = _kind("ConfigurationError", "CONFIG", False)
StorageError = _kind("StorageError", "STORAGE")
IngestionError = _kind("IngestionError", "INGEST")
QueryError = _kind("QueryError", "QUERY")
EvolutionError = _kind("EvolutionError", "EVOLVE")
ExtractionError = _kind("ExtractionError", "EXTRACT")
EmbeddingError = _kind("EmbeddingError", "EMBED")
CommunityError = _kind("CommunityError", "COMMUNITY")
RateLimitError = _kind("RateLimitError", "RATE_LIMIT")
DeadlineError = _kind("DeadlineError", "TIMEOUT")
