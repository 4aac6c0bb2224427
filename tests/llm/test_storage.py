import hashlib
import io
import random
import struct
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from strandlake.llm import byte_bpe, media, token_store, warc
from strandlake.llm.common import open_fs, scratch

BPE, WORDS = P.path("byte_bpe_multi_50k.tiktoken"), P.path("word_bpe_49k.json")
TEXTS = [(5, "Hello world's 12 ünïcode…"), (2, None), (9, ""), (1, "x" * 30000), (None, "no id"), (2, "again  two\n\nlines"), (7, "ab " * 9000)]


def docs(spark, rows=TEXTS):
    return spark.createDataFrame([(i, t, 1, b"z") for i, t in rows], "doc_id long, text string, n_tokens int, media binary")


def public():
    bpe = byte_bpe.load(BPE, P.PATTERN)
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(), st.text("abe 'stAB12\n\t\r .,-_é中\u2028\x1c\x85🙂", max_size=60)))
def test_byte_bpe_equals_the_public_encoder(text):
    bpe = byte_bpe.load(BPE, P.PATTERN)
    ids = np.frombuffer(bpe.encode(text), "<u4").tolist()
    assert ids == public().encode_ordinary(text) and bpe.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["a" * 50000, " " * 20000, "ab" * 20000, "-=" * 9000, "中" * 5000])
def test_long_pieces(text):
    bpe = byte_bpe.load(BPE, P.PATTERN)
    ids = np.frombuffer(bpe.encode(text), "<u4").tolist()
    assert ids == public().encode_ordinary(text) and bpe.decode(ids) == text.encode()


def test_byte_bpe_over_rows(spark):
    rows = sorted(map(tuple, byte_bpe.digests(docs(spark), BPE, P.PATTERN).collect()), key=repr)
    want = []
    for i, t in TEXTS:
        ids = public().encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert rows == sorted(want, key=repr)
    again = byte_bpe.decode(byte_bpe.encode(docs(spark), BPE, P.PATTERN), BPE, P.PATTERN).collect()
    assert sorted(r["decoded"] for r in again) == sorted((t or "").encode() for _, t in TEXTS)
    assert byte_bpe.digests(docs(spark).limit(0), BPE, P.PATTERN).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.text(), st.text("aBé é\u0300\n\t 'S<|endoftext|>12ßİΣ\x1c\x85中\0.,#(", max_size=40)))
def test_runs_encode_like_the_whole_text(text):
    w = token_store.load(WORDS)
    assert np.frombuffer(w.encode(text), "<u4").tolist() == w.tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|endoftext|", "|>", "<|EndOfText|>", "<", " ", "\n", "\x1c", "a", "É", "e\u0301", "\u0301", "İ", "中", "12", "'s", "."]), max_size=12))
def test_added_tokens_encode_as_in_the_library(parts):
    text, t = "".join(parts), Tokenizer.from_file(WORDS)
    assert np.frombuffer(token_store.load(WORDS).encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_special_tokens_are_one_id():
    assert np.frombuffer(token_store.load(WORDS).encode("a <|endoftext|> b<|startoftext|>"), "<u4").tolist() == [320, 49407, 321, 49406]


def test_token_store_round_trip(spark):
    t = Tokenizer.from_file(WORDS)
    d, folder = docs(spark), scratch(spark, "tokens-test")
    token_store.write(d, WORDS, folder, 2)
    whole = {(r["doc_id"], r["start"]): np.frombuffer(r["ids"], "<u4").tolist() for r in token_store.read(spark, folder).collect()}
    short = {(r["doc_id"], r["start"]): (r["n_tokens"], r["ids_crc32"]) for r in token_store.summaries(spark, folder).collect()}
    want = sorted([(-1 if i is None else i, t.encode(x or "", add_special_tokens=False).ids + [2]) for i, x in TEXTS])
    got = sorted((-1 if k[0] is None else k[0], v) for k, v in whole.items())
    assert got == want and set(short) == set(whole)
    start = 0
    for (i, at), ids in sorted(whole.items(), key=lambda x: x[0][1]):
        assert at == start and short[i, at] == (len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)
    order = [-1 if i is None else i for i, _ in sorted(whole, key=lambda k: k[1])]
    assert order == sorted(order)
    rows = sorted(map(tuple, token_store.stored(d.repartition(5), WORDS).collect()), key=lambda r: r[1])
    assert rows == sorted(((i, at, *short[i, at]) for i, at in short), key=lambda r: r[1])  # repeats in the same order
    assert token_store.stored(d.limit(0), WORDS).count() == 0


def test_other_makes_of_tokenizers_take_whole_texts(tmp_path):
    import json

    made = json.load(open(WORDS))
    made["normalizer"] = {"type": "NFC"}
    (tmp_path / "other.json").write_text(json.dumps(made))
    path, text = str(tmp_path / "other.json"), "Hello World <|endoftext|> it's\u2028x  12"
    assert token_store.by_words(WORDS) and not token_store.by_words(path)
    assert np.frombuffer(token_store.load(path).encode(text), "<u4").tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_equal_chunks_are_stored_once_and_damage_is_seen(spark):
    text = " ".join(f"w{i % 211}x{i % 17}" for i in range(4000))
    d, folder = docs(spark, [(i, text) for i in range(20)]), scratch(spark, "tokens-test")
    token_store.write(d, WORDS, folder, 2)
    one, many = spark.read.parquet(f"{folder}/packs-manifest").agg({"entries": "sum"}).first()[0], token_store.summaries(spark, folder).count()
    assert many == 20 and one <= 60
    fs, at = open_fs(spark.read.parquet(f"{folder}/packs-manifest").first()["file"])
    data = bytearray(fs.open_input_stream(at).read())
    data[60] ^= 1
    with fs.open_output_stream(at) as f:
        f.write(bytes(data))
    with pytest.raises(Exception):
        token_store.summaries(spark, folder).collect()


def test_cuts_depend_on_content():
    rng = np.random.default_rng(0)
    ids = rng.integers(0, 49000, 60000).astype("<u4")
    parts = lambda x: {x[a:b].tobytes() for a, b in zip([0, *token_store.cuts(len(x), token_store.marks(x).tolist())], token_store.cuts(len(x), token_store.marks(x).tolist()))}
    a, b = parts(ids), parts(np.concatenate([ids[:5], ids]))
    assert len(a & b) > 0.8 * len(a) and b"".join(sorted(a)) != b""
    assert token_store.cuts(5, []) == [5] and max(map(len, parts(np.zeros(40000, "<u4")))) <= 4 * token_store.MAX_IDS


@given(st.lists(st.binary(max_size=50), max_size=6))
def test_checksums_of_parts(parts):
    assert token_store.crc_of([(zlib.crc32(p), len(p)) for p in parts]) == zlib.crc32(b"".join(parts))


PAGES = [(3, "http://a/1", "<p>" + "x" * 200), (1, "http://a/2", "<p>" + "x" * 200), (2, None, "short"), (4, "u\r\nX: y", "short"), (5, "http://b", None), (6, "http://c", "é" * 60), (7, "d", "é" * 60), (8, "e", "\x1f\ufffd" * 5000), (None, "f", "g" * 100)]


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")


@pytest.mark.parametrize("split", [50, 997, 1 << 20])
def test_archives_are_read_whole_at_any_split(spark, split):
    manifest = warc.write(pages(spark), scratch(spark, "warc-test"))
    rows = {r["page_id"]: r for r in warc.read(manifest, split).collect()}
    assert len(rows) == len(PAGES) and warc.read(manifest, split).count() == len(PAGES)
    for i, _, html in PAGES:
        body, r = (html or "").encode(), rows[i]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(body), hashlib.sha256(body).hexdigest())
        assert r["payload"] == (body if r["record_type"] == "response" else b"")
    assert {i: r["refers_to"] for i, r in rows.items() if r["record_type"] == "revisit"} == {3: 1, 7: 6}


@pytest.mark.parametrize("split", [50, 997, 1 << 20])
def test_damaged_archives_are_errors(spark, split):
    rows = [(i, "u", f"{i} " * 300) for i in range(6)]
    manifest = warc.write(pages(spark, rows).coalesce(1), scratch(spark, "warc-test"))
    for row in manifest.collect():
        fs, at = open_fs(row["file"])
        data = fs.open_input_stream(at).read()
        for place in (0, 9, 14, len(data) // 2, len(data) - 3):
            with fs.open_output_stream(at, compression=None) as f:
                f.write(data[:place] + bytes([data[place] ^ 255]) + data[place + 1 :])
            with pytest.raises(Exception, match="damaged"):
                warc.read(manifest, split).collect()


def test_records_of_other_writers(spark):
    import gzip

    folder = scratch(spark, "warc-test")
    fs, base = open_fs(folder)
    fs.create_dir(base)
    member = lambda head, block: gzip.compress(("\r\n".join(["WARC/1.0", *head, f"Content-Length: {len(block)}"])).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")
    data = member(["WARC-Type: warcinfo", "WARC-Record-ID: <urn:uuid:1>", "Content-Type: application/warc-fields"], b"software: x") + member(
        ["WARC-Type: response", "WARC-Record-ID: <urn:uuid:2>", "WARC-Payload-Digest: sha1:ABC", "Content-Type: application/http; msgtype=response"], b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nhello"
    )
    with fs.open_output_stream(f"{base}/x.warc.gz", compression=None) as f:
        f.write(data)
    manifest = spark.createDataFrame([(f"{folder}/x.warc.gz", len(data), 2)], warc.MANIFEST)
    got = [(r["page_id"], r["payload_bytes"], r["record_type"], bytes(r["payload"])) for r in warc.read(manifest).collect()]
    assert got == [(None, 11, "warcinfo", b"software: x"), (None, 5, "response", b"hello")]


def test_magic_inside_a_member_is_no_record():
    fake = warc.record(9, "u", b"inner", hashlib.sha256(b"inner").hexdigest(), None)
    junk = b"\x1f\x8b\x08\x00" + random.Random(1).randbytes(3000) + b"\x1f\x8b\x08"
    real = warc.record(1, "u", b"outer", hashlib.sha256(b"outer").hexdigest(), None)
    data = junk + real + real
    f = io.BytesIO(data)
    found = [r for k in range(0, len(data), 100) for r in warc.Range(f, k, min(k + 100, len(data)), len(data)).records()]
    assert len(found) == 2 and fake not in data


def test_no_pages(spark):
    assert warc.archived(pages(spark).limit(0)).count() == 0


def test_media_features(spark):
    rows = {(r["doc_id"], r["n_bytes"]): r for r in media.features(media.store(docs(spark))).collect()}
    for i, t in TEXTS:
        raw = (t or "").encode()
        body = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = rows[i, len(raw)]
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-64:]))
        assert r["media_bytes"] == len(body) + 44 and r["media_sha256"] == hashlib.sha256(media.as_wav(body)).hexdigest()
        assert r["feature"].startswith("audio/wav;was=application/octet-stream")
    empty = media.features(media.store(docs(spark).limit(0)))
    assert empty.count() == 0


def a_png():
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def a_zip():
    import zipfile

    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("a.txt", "hello")
    return b.getvalue()


def samples():
    import gzip

    gif = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + bytes(6) + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\x00\x3b"
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x04cd\x12\xff\x00\x34\xff\xd9"
    bmp = b"BM" + struct.pack("<IIIIiiHHIIiiII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + bytes(4)
    pdf = b"%PDF-1.4\nstuff startxref\n9\n%%EOF"
    ogg = b"OggS\0\x04" + bytes(20) + b"\x01\x05hello"
    return {"image/png": a_png(), "image/gif": gif, "image/jpeg": jpeg, "image/bmp": bmp, "audio/wav": media.as_wav(bytes(9)) + b"\0", "audio/ogg": ogg, "application/pdf": pdf, "application/zip": a_zip(), "application/gzip": gzip.compress(b"hi")}


@pytest.mark.parametrize("part", [b"PK\3\4PK\5\6", b"GIF87a......!aaaaaa", b"OggS\0\0" + bytes(20) + b"\0", b"%PDF-1.4 startxref"])
def test_many_candidates_take_linear_time(part):
    import time

    began = time.process_time()
    media.media_in(part * (2_000_000 // len(part)))
    assert time.process_time() - began < 20


def test_what_a_value_is_decides_over_its_declared_type():
    wav = media.as_wav(b"abcd" * 16)
    assert media.opened(wav, "text/plain")[0] == b"abcd" * 16 and media.opened(b"plain", "audio/wav")[0] == b"plain"


@pytest.mark.parametrize("kind", sorted(media.FORMATS))
def test_sniffing_corrects_and_carves(kind):
    data = samples()[kind]
    data = data[:-1] if kind == "audio/wav" else data
    assert media.sniff(data, "text/plain") == (kind, [])
    inside = b"junk BM GIF8 " + data + b" tail " + data
    assert media.sniff(inside, kind)[0] == "application/octet-stream"
    assert [(k, a, n) for k, a, n in media.media_in(inside)] == [(kind, 13, len(data)), (kind, 19 + len(data), len(data))]
    assert media.media_in(data[: len(data) // 2]) == []
