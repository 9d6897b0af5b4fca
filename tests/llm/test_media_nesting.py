"""Deeply nested boxes and long box headers."""

import struct

import pytest

from tests.llm.test_operators import boxed, full, track
from tidewright.llm import media


def test_deep_nesting_is_damage():
    for n in (1000, 100_000):
        f = b"".join(struct.pack(">I4s", 8 * (n - i), b"moov") for i in range(n))
        with pytest.raises(ValueError, match="nested"):
            media.tracks(f)
    f = boxed(b"free")
    for _ in range(media.MAX_DEPTH):
        f = boxed(b"udta", f)
    assert len(list(media.walk(f))) == media.MAX_DEPTH + 1


@pytest.mark.parametrize("long", [False, True])
def test_fragment_with_a_long_header(long):
    """A moof whose size takes 64 bits: offsets count from its first byte."""
    head = boxed(b"moov", track(1, b"avc1", [], [], []), boxed(b"mvex", full(b"trex", struct.pack(">IIIII", 1, 1, 20, 6, 0x10000))))

    def moof(off):
        body = full(b"mfhd", struct.pack(">I", 1)) + boxed(b"traf", full(b"tfhd", struct.pack(">I", 1), flags=0x20000), full(b"trun", struct.pack(">IiIIII", 3, off, 0, 4, 5, 6), flags=0x205))
        return struct.pack(">I4sQ", 1, b"moof", 16 + len(body)) + body if long else boxed(b"moof", body)

    size = len(moof(0))
    (t,) = media.tracks(head + moof(size + 8) + boxed(b"mdat", bytes(15)))
    a = len(head) + size + 8
    assert t["samples"] == [(a, a + 4), (a + 4, a + 9), (a + 9, a + 15)]
