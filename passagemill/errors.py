"""Errors of the public interface. Each names the first offenders and never quotes document text."""

from __future__ import annotations


class SourceContractError(ValueError):
    """The source file or a row of it breaks the contract."""


class GenerationError(ValueError):
    """A snapshot is missing, incomplete or inconsistent."""


class PublicationError(RuntimeError):
    """The snapshot folder can't take a publication or activation."""


class EndpointConfigurationError(ValueError):
    """An embedding endpoint isn't protected."""


class EmbeddingServiceError(RuntimeError):
    """The embedding service failed or gave an unusable answer."""

    def __init__(self, message: str, *, retryable: bool = False):
        super().__init__(message)
        self.retryable = retryable


class IndexBuildError(RuntimeError):
    """An index build or its rows can't be used."""


class IndexNotReadyError(IndexBuildError):
    """No build is active for this snapshot and model."""


class RetrievalInputError(ValueError):
    """Questions or candidates can't be ranked."""


class IndexCompatibilityError(IndexBuildError):
    """The active build was made for other data, another model or other texts."""


def raise_if_any(offenders: list, error: type[Exception], what: str, shown: int = 5) -> None:
    """Raise ``error`` naming the first offenders, if there are any."""
    if offenders:
        more = f" and {len(offenders) - shown} more" if len(offenders) > shown else ""
        raise error(f"{what}: {', '.join(map(str, offenders[:shown]))}{more}")
