"""Terms of a text as runs of bytes: ASCII letters, maybe digits, and all that is not ASCII."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes that are split into terms at once.
WINDOW = 4 << 20


def _table(digits: bool) -> bytes:
    """A-Z to lower case, what is in no term to a space. Bytes from 0x80 stay: UTF-8 has them in other characters only."""
    kept = {b: chr(b).lower() for b in range(128) if chr(b).isalpha() or digits and chr(b).isdigit()}
    return bytes(b if b > 127 else ord(kept.get(b, " ")) for b in range(256))


LETTERS, LETTERS_DIGITS = _table(False), _table(True)


def terms(data: bytes, table: bytes) -> Iterator[list[bytes]]:
    """The terms in order, in lists for a window each, cut between terms."""
    data = data.translate(table)
    start = 0
    while start < len(data):
        stop = start + WINDOW
        if stop < len(data):
            cut = data.rfind(b" ", start, stop)
            stop = cut if cut > start else data.find(b" ", stop)
            stop = len(data) if stop < 0 else stop
        yield data[start:stop].split()
        start = stop


def raw(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()
