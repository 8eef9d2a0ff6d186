"""Exceptions, raised on the driver when a plan is built unless noted."""


class FrameError(ValueError):
    """Any rule of the frame model that is broken."""


class SchemaError(FrameError):
    """An invalid, unsupported or incompatible schema."""


class KeyValueError(FrameError):
    """A key that does not parse, does not fit its type or cannot be a key."""


class KeyOrderError(FrameError):
    """A key below its predecessor; names both."""

    def __init__(self, key: object, previous: object, where: str = "") -> None:
        self.key, self.previous = key, previous
        super().__init__(f"key {key} is below the previous key {previous}{where and f' ({where})'}")


class RangeError(FrameError):
    """A frame range outside the dataset, or ranges that are not ordered and disjoint."""


class SelectorError(FrameError):
    """Selector text that does not parse, or a reversed range in it."""


class StringTableError(FrameError):
    """String tables that disagree, or an index outside the table (on executors)."""


class FormatError(FrameError):
    """A file that is not what its header says."""


class HeaderError(FormatError):
    """Bytes at a file's start that are no header of either layout, or one with impossible values."""


class LengthError(FormatError):
    """A file of another length than its header says."""


class PageError(FormatError):
    """A page whose header, checksum, payload or place is wrong; names the page."""

    def __init__(self, page: int, what: object) -> None:
        self.page = page
        super().__init__(f"page {page}: {what}")


class IncompatibleError(FrameError):
    """Datasets that cannot be joined end to end: titles, schemas or formats differ."""
