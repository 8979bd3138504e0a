"""What can go wrong, as exceptions."""


class CorvaneError(Exception):
    """Any error of this library."""


class InvalidVector(CorvaneError, ValueError):
    pass


class InvalidId(CorvaneError, ValueError):
    pass


class InvalidMetadata(CorvaneError, ValueError):
    pass


class InvalidConfig(CorvaneError, ValueError):
    pass


class InvalidSearch(CorvaneError, ValueError):
    pass


class FilterError(CorvaneError, ValueError):
    pass


class NotFound(CorvaneError, KeyError):
    pass


class AlreadyExists(CorvaneError):
    pass


class EmptyCollection(CorvaneError):
    pass


class IntegrityError(CorvaneError):
    pass


class ArchiveError(CorvaneError):
    pass


class LockTimeout(CorvaneError, TimeoutError):
    pass


class Conflict(CorvaneError):
    """Another writer changed the collection meanwhile; nothing was done."""
