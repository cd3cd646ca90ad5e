"""Reading archives back: offsets, borders between pieces, and work in proportion to the archive."""

import random
import zlib

from alignframe.llm import warc


unpacker = zlib.decompressobj


class Counted:
    """An unpacker that adds up the bytes it is given."""

    given = 0

    def __init__(self, wbits):
        self.inner = unpacker(wbits)

    def decompress(self, data):
        Counted.given += len(data)
        return self.inner.decompress(data)

    def __getattr__(self, name):
        return getattr(self.inner, name)


def written(sizes):
    rng = random.Random(3)
    payloads = [rng.randbytes(n) for n in sizes]
    return payloads, [warc.record(i, f"http://a.example/{i}", i, p, b"\0" * 20, None) for i, p in enumerate(payloads)]


def same(payloads, members):
    found = list(warc.records(b"".join(members)))
    assert [at for at, _, _ in found] == [sum(map(len, members[:i])) for i in range(len(members))]
    assert [block.partition(b"\r\n\r\n")[2] for _, _, block in found] == payloads
    assert [h["WARC-Record-ID"] for _, h, _ in found] == [warc.page_urn(i) for i in range(len(members))]


def test_archive_is_read_in_proportion_to_its_size(monkeypatch):
    payloads, members = written([1000] * 1500)
    monkeypatch.setattr(warc.zlib, "decompressobj", Counted)
    monkeypatch.setattr(Counted, "given", 0)
    same(payloads, members)
    # Each record used to be unpacked from all that was left of the archive, which was copied as what follows it.
    assert Counted.given < 10 * sum(map(len, members))


def test_records_at_the_borders_of_pieces():
    assert list(warc.records(b"")) == []
    same(*written([0, 1, 100_000, 0, 3 << 20, 5]))
    for n in range(3400, 4200, 7):
        same(*written([n, 10, n]))
