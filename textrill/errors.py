"""What the engine refuses, and why."""


class AccessIsEmpty(ValueError):
    """No access token at all: such a document could never be found, such a viewer finds nothing."""


class UnknownDocument(LookupError):
    """No stored document has this provider and id."""


class UnsupportedCapability(ValueError):
    """The request narrows its result in a way this engine does not offer; ignoring it would show too much."""


class UnsupportedEngine(ValueError):
    """There is no ranking profile of this name."""


class StoreConflict(RuntimeError):
    """Another writer committed while this one was at work; nothing was changed."""
