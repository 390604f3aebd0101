"""Errors; all are raised on the driver before a result is returned."""


class EventloomError(Exception):
    """Root of all errors."""


class FCSError(EventloomError):
    """A file that isn't readable as FCS 3.1."""


class UnsupportedFCSVersion(FCSError): ...
class MalformedHeader(FCSError): ...
class MalformedText(FCSError): ...
class MissingKeyword(FCSError): ...
class InconsistentMetadata(FCSError): ...
class TruncatedData(FCSError): ...
class UnsupportedFCSFeature(FCSError): ...


class MarkerError(EventloomError):
    """A marker that names no channel, or several."""


class UnknownMarker(MarkerError): ...
class AmbiguousMarker(MarkerError): ...
class ConfigurationError(EventloomError): ...
class CommunityNotFound(EventloomError): ...
class InsufficientData(EventloomError): ...
