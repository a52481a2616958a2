"""Errors of the byte kernels."""


class CodecError(ValueError):
    """Any failure of encoding or decoding."""


class EmptyInput(CodecError):
    """There is nothing to encode."""


class TypeMismatch(CodecError):
    """The length isn't a multiple of the element's width."""


class StrideMismatch(CodecError):
    """The length or the schema doesn't fit the record width."""


class LossyConfigError(CodecError):
    """Vector size, bits, type or stride don't allow quantization."""


class Corrupted(CodecError):
    """The bytes aren't a valid stream."""


class ChecksumMismatch(Corrupted):
    """A block's CRC-32 or the seek table's differs."""


class IntegrityFailed(Corrupted):
    """The digest of the content differs."""


class BlockIndexOutOfRange(CodecError):
    """No such block."""


class ByteRangeOutOfBounds(CodecError):
    """The byte range ends after the content."""


class MissingSeekTable(CodecError):
    """Random access needs a seek table."""
