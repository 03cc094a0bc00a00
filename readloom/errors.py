"""Exceptions of this library, all RuntimeErrors. Option errors are also ValueErrors."""


class ReadloomError(RuntimeError):
    pass


class InvalidOption(ReadloomError, ValueError):
    """An unknown codec, key or field, or options that do not go together."""


class CodecMismatch(ReadloomError):
    """A dataset was written with another codec than the reader was told."""


class KeyMismatch(ReadloomError):
    """A dataset's record key has another tag or width than the reader was told."""


class MissingKey(ReadloomError):
    """A key was asked for, but the dataset has none, or the other way round."""


class DestinationExists(ReadloomError):
    """A temporary dataset was to be kept where something is already."""


class LengthMismatch(ReadloomError):
    """A read's sequence and quality differ in length."""


class KeyWidth(ReadloomError):
    """A record's key is null or has not the bytes of its kind."""
