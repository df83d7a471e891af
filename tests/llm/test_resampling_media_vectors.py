"""Resampling to a target, media columns and vector codes: brute force, round trips, and rows of every awkward kind."""

import hashlib
import math
import os
import random
import struct
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import brute  # noqa: E402
from test_llm import SCHEMA, awkward, plain  # noqa: E402

from tidemark.llm import media, resampling, vectors  # noqa: E402


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- resampling ---


@given(st.text(alphabet="aB9 .é日\n-", max_size=60), st.integers(1, 4))
@settings(max_examples=300, deadline=None)
def test_the_ring_has_the_checksum_of_every_run(text, n):
    n_words, at, counts = resampling.bucket_counts(text, n, 997)
    assert n_words == len(brute.words_of(text))
    assert dict(zip(at.tolist(), counts.tolist())) == Counter(brute.run_buckets(text, n, 997))
    assert at.tolist() == sorted(at)


def test_the_ring_goes_on_over_pieces_of_a_long_text(monkeypatch):
    random.seed(4)
    text = " ".join(random.choice(["a", "Bc", "dé", "x-y", "9" * 50]) for _ in range(2000)) + " " * 300 + "end"
    want = Counter(brute.run_buckets(text, 3, 100))
    for piece in (1, 10, 1000, 1 << 20):
        monkeypatch.setattr(resampling, "PIECE", piece)
        n_words, at, counts = resampling.bucket_counts(text, 3, 100)
        assert dict(zip(at.tolist(), counts.tolist())) == want and n_words == len(brute.words_of(text))


@pytest.mark.parametrize("options", [{}, {"n": 3, "buckets": 50, "least_words": 1, "percent": 55, "seed": 7}, {"percent": 100, "least_words": 0}])
def test_resampling_by_brute_force(spark, docs, options):
    target = [(1, "one two words CC BY"), (2, None), (3, ""), (4, "call me, all rights reserved")]
    got = resampling.resample_to_target(docs, spark.createDataFrame(target, "item_id int, text string"), **options).collect()
    want = brute.resampled(plain(), [t for _, t in target], **options)
    assert Counter(map(tuple, got)) == Counter((r[0], *r[2:]) for r in want)
    ranks = sorted(r["rank"] for r in got if r["rank"] is not None)
    assert ranks == list(range(1, len(ranks) + 1)) and ranks


def test_resampling_of_nothing_and_towards_nothing(spark, docs, empty):
    none = spark.createDataFrame([], "text string")
    assert resampling.resample_to_target(empty, docs).count() == 0
    got = resampling.resample_to_target(docs, none).collect()
    assert Counter(map(tuple, got)) == Counter((r[0], *r[2:]) for r in brute.resampled(plain(), []))


def test_resampling_takes_other_columns(spark):
    rows = spark.createDataFrame([(i, f"word{i % 3} " * 25, 0, 0, 0) for i in range(40)], "id int, body string, rank int, score int, buckets int")
    target = spark.createDataFrame([("word1 word1",)], "goal string")
    got = resampling.resample_to_target(rows, target, id_col="id", text_col="body", target_col="goal").where("rank is not null").collect()
    assert len(got) == 4 and all(r.doc_id % 3 == 1 for r in got)


# --- media ---


def boxes(data):
    """A plain walk of the top boxes: [(kind, body)]."""
    out, at = [], 0
    while at < len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        out.append((kind, data[at + 8 : at + size]))
        at += size
    return out


def test_media_by_a_plain_reader(docs, empty):
    want = Counter()
    for i, t in plain():
        raw = t.encode()
        payload = raw + bytes(64 if not raw else -len(raw) % 64)
        want[i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])] += 1
    stored = media.store_texts(docs)
    got = media.digest_media(stored).collect()
    assert Counter(tuple(r)[:5] for r in got) == want
    files = {hashlib.sha256(r.media).hexdigest(): bytes(r.media) for r in stored.collect()}
    for r in got:
        file = files[r.media_sha256]
        top = dict(boxes(file))
        assert list(top) == [b"ftyp", b"mdat", b"moov"] and r.media_bytes == len(file)
        frames = len(top[b"mdat"]) // 64
        first = file.index(b"mdat") + 4
        assert hashlib.sha256(top[b"mdat"]).hexdigest() == r.payload_sha256
        keys = ",".join(f"{first + 64 * k}+64" for k in range(0, frames, 12))
        assert r.feature == f"raw 8x8 {frames}/25 {frames} {keys}"
    assert media.digest_media(media.store_texts(empty)).count() == 0


@given(st.binary(max_size=3000))
@settings(max_examples=200, deadline=None)
def test_media_is_a_round_trip(raw):
    payload = raw + bytes(-len(raw) % 64 if raw else 64)
    file = media.store(payload)
    (t,) = media.describe(file)
    assert media.stored(file, t) == payload and (t.codec, t.kind, t.duration, t.timescale) == ("raw ", "vide", len(payload) // 64, 25)
    assert t.keyframes() == [(t.starts[k], 64) for k in range(0, len(t.starts), 12)]


def test_payloads_that_cannot_be_stored():
    for payload in (b"", b"x", bytes(65)):
        with pytest.raises(ValueError):
            media.store(payload)


def with_tables(codec=b"mp4a", kind=b"soun", mdat=b"", brand=b"mp42", extra=b"", **tables):
    """A file of one track with the given tables (their bodies after version and flags); mdat comes first, its body at 24."""
    full = lambda k, body: media.box(k, bytes(4), body)
    stbl = media.box(b"stbl", full(b"stsd", struct.pack(">I", 1) + media.box(codec, bytes(28))), *(full(k.encode(), v) for k, v in tables.items()))
    mdia = media.box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, 48000, 0, 0, 0)), full(b"hdlr", struct.pack(">I4s12x", 0, kind)), media.box(b"minf", stbl))
    track = media.box(b"trak", full(b"tkhd", struct.pack(">III", 0, 0, 7) + bytes(68)), mdia)
    return media.box(b"ftyp", brand + bytes(4)) + media.box(b"mdat", mdat) + media.box(b"moov", track, extra)


def u4(*values):
    return struct.pack(f">{len(values)}I", *values)


def test_sample_tables_of_other_shapes():
    data = bytes(range(200))
    common = {"mdat": data, "stts": u4(2, 4, 1024, 1, 10), "stsc": u4(2, 1, 2, 1, 2, 1, 1)}
    sizes = [5, 7, 11, 2, 9]
    starts = [124, 129, 64, 100, 30]  # chunks of 2, 1, 1, 1 samples
    places = u4(4, 124, 64, 100, 30)
    wide = struct.pack(">I4Q", 4, 124, 64, 100, 30)
    for tables in ({"stsz": u4(0, 5, *sizes), "stco": places}, {"stz2": u4(8, 5) + bytes(sizes), "co64": wide}, {"stz2": u4(4, 5) + bytes([0x57, 0xB2, 0x90]), "stco": places}):
        (t,) = media.describe(with_tables(**common, **tables))
        assert (t.number, t.codec, t.kind, t.timescale, t.duration) == (7, "mp4a", "soun", 48000, 4106)
        assert t.starts.tolist() == starts and t.sizes.tolist() == sizes and t.key.all()
        assert t.keyframes() == [(124, 12), (64, 11), (100, 2), (30, 9)]
    (t,) = media.describe(with_tables(**common, stsz=u4(0, 5, *sizes), stco=places, stss=u4(2, 2, 5)))
    assert t.keyframes() == [(129, 7), (30, 9)]
    (t,) = media.describe(with_tables(mdat=data, stts=u4(0), stsc=u4(0), stsz=u4(0, 0), stco=u4(0)))
    assert t.keyframes() == [] and media.stored(b"", t) == b"" and t.duration == 0


def test_large_and_open_boxes():
    payload = bytes(range(64))
    file = media.store(payload)
    top = boxes(file)
    body = dict(top)[b"mdat"]
    wide = media.box(b"ftyp", bytes(0)) + struct.pack(">I4sQ", 1, b"mdat", 16 + len(body)) + body
    assert [(p, b) for p, b, _ in media.walk(memoryview(wide))] == [((b"ftyp",), 8), ((b"mdat",), 24)]
    assert [(b, e) for _, b, e in media.walk(memoryview(struct.pack(">I4s", 0, b"mdat") + body))] == [(8, 72)]


def test_fragments_add_their_samples():
    trex = media.box(b"mvex", media.box(b"trex", bytes(4), u4(7, 1, 1000, 4, 0x10000)))
    head = with_tables(codec=b"avc1", kind=b"vide", extra=trex, stts=u4(0), stsc=u4(0), stsz=u4(0, 0), stco=u4(0))
    run = lambda *parts, flags: media.box(b"trun", u4(flags), *parts)
    head_of = lambda *parts, flags=0: media.box(b"tfhd", u4(flags), u4(7), *parts)
    first = media.box(b"moof", media.box(b"traf", head_of(), run(u4(3), struct.pack(">i", 100), u4(0), u4(6, 5, 9), flags=0x205)))
    other = media.box(b"moof", media.box(b"traf", head_of(u4(8), flags=0x10), run(u4(2), struct.pack(">i", 50), u4(20, 0, 30, 0x10000), flags=0x501), run(u4(1), flags=0)))
    at = len(head)
    file = head + first + media.box(b"mdat", bytes(192)) + other + media.box(b"mdat", bytes(192))
    (t,) = media.describe(file)
    second = at + len(first) + 200
    assert t.starts.tolist() == [at + 100, at + 106, at + 111, second + 50, second + 58, second + 66] and t.sizes.tolist() == [6, 5, 9, 8, 8, 8]
    assert t.key.tolist() == [True, False, False, True, False, False] and t.duration == 50


def test_broken_files_are_told_and_never_fail(spark):
    good = media.store(bytes(640))
    huge = [good.replace(b"stsz" + bytes(4) + u4(64, 10), b"stsz" + bytes(4) + u4(64, n)) for n in (11, 1 << 31)]
    huge += [good.replace(b"stts" + bytes(4) + u4(1, 10, 1), b"stts" + bytes(4) + u4(1 << 30, 10, 1)), good.replace(b"stco" + bytes(4) + u4(1, 32), b"stco" + bytes(4) + u4(1, 1 << 30))]
    rows = [(0, good), (1, None), (2, b""), (3, b"not a movie"), (4, good[:-1]), (5, good[:40]), *((6 + i, x) for i, x in enumerate(huge))]
    df = spark.createDataFrame(rows, "doc_id long, media binary")
    got = {r.doc_id: r.m for r in df.select("doc_id", media.media_tracks().alias("m")).collect()}
    assert got[0].problem is None and [(t.codec, t.samples, t.bytes, [tuple(k) for k in t.keyframes]) for t in got[0].tracks] == [("raw ", 10, 640, [(32, 64)])]
    assert got[1] == (None, None) and got[2] == ([], None)
    assert all(got[i].tracks is None and got[i].problem for i in range(3, len(rows)))
    digests = media.digest_media(df.withColumn("n_bytes", F.lit(1).cast("long"))).collect()
    assert all((r.payload_bytes is None) == (r.doc_id != 0) and (r.media_bytes is None) == (r.doc_id == 1) for r in digests)
    rng = random.Random(8)
    for _ in range(1500):
        x = bytearray(good)
        for _ in range(rng.randint(1, 4)):
            x[rng.randrange(len(x))] = rng.choice([0, 1, 255, rng.randrange(256)])
        try:
            tracks = media.describe(bytes(x[: rng.randint(1, len(x))] if rng.random() < 0.3 else x))
            assert all(len(media.stored(bytes(x), t)) <= len(x) * max(1, len(t.starts)) for t in tracks)
        except media.Broken:
            pass


# --- vectors ---

VECTORS = "vec_id long, embedding array<float>, label int, code string, error int, x int, part int, entry int, n int, at int, s int"


def vector_rows(seed=2):
    rng = random.Random(seed)
    rows = [(i * 2, [rng.gauss(0, 0.3) for _ in range(16)], rng.choice([1, 2, None, None])) for i in range(120)]
    rows = [(i, np.float32(v).tolist(), label) for i, v, label in rows]
    rows += [rows[5], rows[5], (4, rows[9][1], 3), (None, rows[7][1], 2), (None, rows[8][1], None)]
    rows += [(900, None, 1), (1, [None] + rows[0][1][1:], 1), (2, [math.nan] * 16, 1), (3, [math.inf] + rows[0][1][1:], 5), (5, [-math.inf] * 16, None)]
    rows += [(7, [0.5] * 11, 1), (9, [], 2), (11, [0.25] * 13, None)]
    return rows


def check(got, rows, **options):
    want, books = brute.vector_codes(rows, **options)
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    by = defaultdict(int)
    for i, (_, error) in want.items():
        by[rows[i][2]] += error
    assert Counter(map(tuple, got)) == Counter((rows[i][0], code, error, min(by[rows[i][2]], 2**63 - 1), sha) for i, (code, error) in want.items())


@pytest.mark.parametrize("options", [{}, {"parts": 5, "entries": 7, "rounds": 2}, {"parts": 1, "entries": 256, "rounds": 1}, {"parts": 16, "entries": 3, "rounds": 4, "scale": 10}])
def test_vector_codes_by_brute_force(spark, options, monkeypatch):
    monkeypatch.setattr(vectors, "ROWS", 50)
    rows = vector_rows()
    df = spark.createDataFrame([(*r, *(None,) * 8) for r in rows], VECTORS).repartition(4)
    check(vectors.compress(df, **options).collect(), rows, **options)


def test_vectors_beyond_a_long_few_vectors_and_none(spark):
    kinds = "vec_id long, embedding array<double>, label int"
    far = [(i, [s * 10.0**e * (1 + i / 7) for s, e in ((1, 300), (-1, 9), (1, 2), (-1, 0))] * 2, i % 2) for i in range(9)]
    check(vectors.compress(spark.createDataFrame(far, kinds)).collect(), far)
    assert vectors.compress(spark.createDataFrame([], kinds)).count() == 0
    assert vectors.compress(spark.createDataFrame([(1, None, 1), (2, [math.nan], 1)], kinds)).count() == 0
    bare = [(3, [], 1), (4, [], None)]
    check(vectors.compress(spark.createDataFrame(bare, kinds)).collect(), bare)
    other = spark.createDataFrame([(i, [i / 9] * 8) for i in range(40)], "id int, v array<double>")
    got = vectors.compress(other, id_col="id", vector_col="v", label_col=None).collect()
    assert len(got) == 40 and len({r.label_error for r in got}) == 1


@given(st.integers(0, 10_000), st.integers(1, 13), st.integers(1, 20), st.sampled_from([1, 3, 300, 1 << 29]))
@settings(max_examples=150, deadline=None)
def test_nearest_entries_behind_the_bounds_are_exact(seed, width, entries, spread):
    rng = np.random.default_rng(seed)
    part, book = rng.integers(-spread, spread + 1, (60, width)), rng.integers(-spread, spread + 1, (entries, width))
    book[rng.integers(0, entries)] = book[0]
    part[:entries] = book[:60]
    every = ((part[:, None] - book[None]) ** 2).sum(axis=2)
    at, least, _ = vectors.Codebook(book).nearest(part)
    assert at.tolist() == every.argmin(axis=1).tolist() and least.tolist() == every.min(axis=1).tolist()


def test_bounds_leave_most_entries_of_spread_out_codebooks_unmeasured():
    rng = np.random.default_rng(1)
    centres = rng.integers(-3000, 3000, (16, 8))
    part = centres[rng.integers(0, 16, 5000)] + rng.integers(-200, 200, (5000, 8))
    measured = vectors.Codebook(centres).nearest(part)[2] / len(part)
    assert measured < 16 / 3
