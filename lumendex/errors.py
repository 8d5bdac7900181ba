"""Exceptions of the catalogue."""


class LumendexError(Exception):
    """Base of all errors of this library."""


class SourceNotFound(LumendexError):
    """The source path does not exist."""


class SourceNotDirectory(LumendexError):
    """The source path is not a directory."""


class SourceAlreadyExists(LumendexError):
    """The source is registered already."""


class SourceNotRegistered(LumendexError):
    """The source is not registered."""


class GroupNotFound(LumendexError):
    """No duplicate group has this id."""


class UnsupportedFormat(LumendexError):
    """The file extension is not a supported one."""


class PackPathNotSet(LumendexError):
    """No pack path has been configured."""


class PackPathNotFound(LumendexError):
    """The pack path is not a directory."""


class ExportPathNotFound(LumendexError):
    """The export path is not a directory."""


class ConversionFailed(LumendexError):
    """An encoder could not convert a file."""


class EncoderNotAvailable(LumendexError):
    """No encoder for the export format is installed."""


class SchemaTooNew(LumendexError):
    """The catalogue was written by a later version."""


class CatalogueError(LumendexError):
    """The catalogue's tables could not be read or written."""


class IntegrityError(CatalogueError):
    """A key would repeat or point to nothing."""
