import hashlib
import random
import zlib

import numpy as np

from shardwise.llm import media
from tests.llm.cases import documents, frame


def test_round_trip_of_all_sizes():
    rng = random.Random(1)
    for n in [*range(0, 400, 7), 3071, 3072, 3073, 50_000]:
        payload = media.padded(np.frombuffer(rng.randbytes(n), dtype=np.uint8))
        stored = media.mux(payload)
        s = media.parse_stream(stored)
        assert len(stored) % 188 == 0 and s.payload == payload.tobytes()
        assert (s.lost, s.continuity_errors, s.bad_tables, len(s.programs)) == (0, 0, 0, 1)
        assert [u[4] for u in s.units] == [3600 * k for k in range(len(s.units))]
        assert [u[6] for u in s.units] == [k % media.GROUP == 0 for k in range(len(s.units))]


def test_broken_streams():
    stored = media.mux(media.padded(np.frombuffer(random.Random(2).randbytes(9000), dtype=np.uint8)))
    packets = [stored[k : k + 188] for k in range(0, len(stored), 188)]
    assert media.parse_stream(b"".join(packets[:10] + packets[11:])).continuity_errors == 1
    again = media.parse_stream(b"".join(packets[:10] + packets[9:]))
    assert again.continuity_errors == 0 and again.payload == media.parse_stream(stored).payload
    assert media.parse_stream(b"".join(packets[:5]) + b"\0" * 188 + b"".join(packets[5:])).lost == 1
    bad = bytearray(stored)
    bad[20] ^= 1
    assert media.parse_stream(bytes(bad)).bad_tables == 1
    assert media.parse_stream(b"").units == [] and media.parse_stream(b"\x47" * 188).units == []


def test_columns(spark):
    stored = media.store_texts(frame(spark)).cache()
    got = {r["doc_id"]: r for r in media.digests(stored).collect()}
    for i, text in documents():
        raw = (text or "").encode()
        payload = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-16:])
    assert got[0]["media_sha256"] == got[1]["media_sha256"] and got[0]["feature"] == got[1]["feature"]
    parsed = media.parse_column(stored).where("doc_id = 9").first()
    assert sum(u["size"] for u in parsed["units"]) == len(parsed["payload"]) and parsed["units"][0]["random_access"]
    assert media.digests(media.store_texts(frame(spark).where("false"))).count() == 0
