"""Errors that the table raises."""


class KVError(Exception):
    """Base of all errors of this package."""

    def is_not_found(self) -> bool:
        return isinstance(self, NotFound)


class NotFound(KVError):
    """The key has no live version."""


class Corruption(KVError):
    """Stored data breaks an invariant."""


class InvalidArgument(KVError):
    """The call cannot be honoured as asked."""


class NotSupported(KVError):
    """The feature does not exist."""


class IoFailure(KVError):
    """The file system refused."""
