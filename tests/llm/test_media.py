import gzip
import io
import random
import struct
import zipfile

from voxgauge.llm import media_formats as m
from voxgauge.llm.media import media_round_trip, payload_of, sniff_media

SAMPLES = bytes(range(192)) * 3
GIF = (b"GIF89a\x01\0\x01\0\x80\0\0\0\0\0\xff\xff\xff!\xf9\x04\0\0\0\0\0,\0\0\0\0\x01\0\x01\0\0\x02\x02D\x01\0;")
JPEG = b"\xff\xd8\xff\xe0\0\x10JFIF\0\x01\x01\0\0\x01\0\x01\0\0\xff\xda\0\x08\x01\x01\0\0?\0\x7f\xff\xd9"
PDF = b"%PDF-1.4\n1 0 obj\nendobj\nxref\nstartxref\n9\n%%EOF"


def archive():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "hello")
    return out.getvalue()


GOOD = {
    "image/png": m.png(SAMPLES), "audio/wav": m.wav(SAMPLES), "image/bmp": m.bmp(SAMPLES),
    "image/x-portable-graymap": m.pgm(SAMPLES), "image/gif": GIF, "image/jpeg": JPEG, "application/pdf": PDF,
    "application/zip": archive(), "application/gzip": gzip.compress(b"hello" * 50),
    "audio/basic": struct.pack(">4s5I", b".snd", 24, 4, 2, 8000, 1) + b"abcd",
    "image/x-portable-pixmap": b"P6 2 1 255\n" + b"abcdef",
    "audio/ogg": b"OggS\0\2" + b"\0" * 20 + b"\x01\x03" + b"abc",
    "video/mp4": struct.pack(">I4s4sI", 16, b"ftyp", b"isom", 0) + struct.pack(">I4s", 8, b"moov"),
}


def test_writers_are_lossless():
    rng = random.Random(1)
    for kind, write in m.WRITERS:
        for rows in (1, 7):
            samples = rng.randbytes(192 * rows)
            assert m.samples_of(write(samples), kind) == samples
            assert m.sniff(write(samples))[0] == (kind, 0, len(write(samples)))


def test_every_format_is_confirmed_and_carved():
    for kind, data in GOOD.items():
        assert m.sniff(data)[0] == (kind, 0, len(data)), kind
        inside = b"some text BM P5 RIFF %PDF- " + data + b" more PK\x03\x04 text"
        assert [(i.media_type, body) for i, body in m.carve(inside)] == [(kind, data)], kind


def test_broken_files_are_refused():
    for kind, data in GOOD.items():
        if kind not in ("video/mp4", "audio/ogg"):
            assert not any(i.media_type == kind for i in m.sniff(data[:-1])), kind
    spoilt = bytearray(GOOD["image/png"])
    spoilt[40] ^= 1
    assert m.sniff(bytes(spoilt)) == []
    assert m.sniff(b"") == [] and m.sniff(b"ftyp") == [] and m.sniff(b"RIFF\0\0") == []


def test_several_items():
    data = b"x" + GIF + b"--" + GOOD["audio/wav"] + JPEG
    assert [i.media_type for i in m.sniff(data)] == ["image/gif", "audio/wav", "image/jpeg"]


def test_types_are_corrected(spark):
    rows = [(1, GIF, "image/png", "x"), (2, GIF, "image/gif", None), (3, b"plain", "image/gif", "y"), (4, None, None, "z"),
            (5, b"a" + GIF, None, "z")]
    df = spark.createDataFrame(rows, "id int, media binary, declared string, embedded string")
    found = {r["id"]: (r["media_type"], r["corrected"], [tuple(e) for e in r["embedded"]]) for r in sniff_media(df).collect()}
    assert found == {1: ("image/gif", True, []), 2: ("image/gif", False, []), 3: (None, False, []), 4: (None, False, []),
                     5: (None, False, [("image/gif", 1, len(GIF))])}


def test_round_trip(docs, doc_rows, odd, odd_rows, none):
    for df, texts in ((docs, list(doc_rows.items())), (odd, [r[:2] for r in odd_rows])):
        rows = media_round_trip(df).collect()
        assert sorted((r["doc_id"] or -1, r["n_bytes"], bytes(r["payload"])) for r in rows) == sorted(
            (i or -1, len((t or "").encode()), payload_of(t)) for i, t in texts)
        features = {}
        for r in rows:
            assert r["corrected"] == (r["media_type"] != r["declared"])
            assert features.setdefault(bytes(r["payload"]), (r["feature"], bytes(r["media"]))) == (
                r["feature"], bytes(r["media"]))
    assert len(payload_of(None)) == 192 and len(payload_of("x" * 192)) == 192 and len(payload_of("x" * 193)) == 384
    assert media_round_trip(none).collect() == []
