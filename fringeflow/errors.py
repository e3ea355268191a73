"""What can go wrong, by kind; each is also the built-in exception that a caller would expect."""


class FringeError(Exception):
    pass


class StackIOError(FringeError, OSError):
    """A file cannot be read or written; the message names its path."""


class RasterError(FringeError, OSError):
    pass


class DimensionMismatch(FringeError, ValueError):
    pass


class InvalidNetwork(FringeError, ValueError):
    pass


class InversionError(FringeError, RuntimeError):
    pass


class MetadataError(FringeError, ValueError):
    pass


class UnsupportedFormat(FringeError, ValueError):
    pass
