import gzip
import random
import time

import pytest

from rolefit.llm import warc as W


def _plain(k, payload):
    return gzip.decompress(W.encode_record(k, f"u{k}", payload))


def _ids(data):
    found = list(W.salvage(data))
    return [x.headers["warc-record-id"][10:-1] for x in found if isinstance(x, W.Record)], [x for x in found if isinstance(x, W.Gap)]


def test_bad_record_inside_a_member():
    parts = [_plain(k, b"text %d " % k * 20) for k in range(5)]
    parts[2] = parts[2].replace(b"text 2", b"test 2", 1)
    data = gzip.compress(b"".join(parts)) + W.encode_record(9, "u", b"last")
    ids, gaps = _ids(data)
    assert ids == ["0", "1", "3", "4", "9"] and len(gaps) == 1 and "digest" in gaps[0].reason


def test_cut_off_and_damaged_members():
    rng = random.Random(5)
    records = [_plain(k, rng.randbytes(3000)) for k in range(60)]
    member = gzip.compress(b"".join(records))
    ids, gaps = _ids(member[: len(member) // 2])
    assert ids == [str(k) for k in range(len(ids))] and 25 <= len(ids) <= 30 and len(gaps) == 1
    tail = W.encode_record(99, "u", b"after")
    ids, gaps = _ids(member[:-8] + b"\0" * 8 + tail)
    assert ids == [str(k) for k in range(60)] + ["99"] and [(g.start, g.end) for g in gaps] == [(0, len(member))]


@pytest.mark.parametrize("seed", range(30))
def test_damage_anywhere_loses_only_records_it_touches(seed):
    rng = random.Random(seed)
    members = [W.encode_record(k, f"u{k}", rng.randbytes(rng.randrange(400))) for k in range(12)]
    data, at = bytearray(b"".join(members)), rng.randrange(sum(map(len, members)))
    data[at] ^= 1 << rng.randrange(8)
    hit = next(k for k in range(12) if at < sum(map(len, members[: k + 1])))
    ids, gaps = _ids(bytes(data))
    assert set(ids) >= {str(k) for k in range(12)} - {str(hit)} and len(ids) == len(set(ids))
    if not gaps:  # a bit of the member's own head that changes nothing
        assert len(ids) == 12


def test_many_small_members_take_linear_time():
    one = W.encode_record(1, "u", b"x" * 50)
    took = []
    for n in (4_000, 16_000):
        start = time.process_time()
        assert sum(1 for _ in W.salvage(one * n)) == n
        took.append(time.process_time() - start)
    assert took[1] < 8 * took[0]
