"""Encoding, token store, packing, media, top-k, URL rules and WARC: round trips and brute force."""

import hashlib
import random
import struct
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from manifolder.llm import entries, media, packing, token_store, topk, url_rules, warc, zdict
from manifolder.llm.encoder import Encoder
from manifolder.llm.runtime import Workspace, open_fs

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, ids binary, part int, start long, media binary"
ROWS = [
    (5, "The quick brown fox.\nThe lazy  dog.", b"x", 1, 1, b"x"),
    (2, None, None, None, None, None),
    (3, "", b"", 0, 0, b""),
    (9, "word " * 5000, b"", 0, 0, b""),
    (5, "repeated id", b"", 0, 0, b""),
    (7, "repeated row", b"", 0, 0, b""),
    (7, "repeated row", b"", 0, 0, b""),
    (11, "äöü € 😀 <|endoftext|>", b"", 0, 0, b""),
    (None, "without an id", b"", 0, 0, b""),
    (-4, "x", b"", 0, 0, b""),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def ids_of():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


ENCODER = Encoder(PATH, cached_words=50)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from([" ", " ", " ", "\n", "a", "B", "é", "1", ".", ",", "'s", "\t", "\u00a0", "\x1c", "\u3000", "word", "<|endoftext|>", "x.\ny", "\r\n"]), max_size=14).map("".join) | st.text(max_size=20))
def test_encoder_equals_library(text):
    assert ENCODER.encode(text) == ENCODER.encode_whole(text)


def test_encoder_equals_library_on_documents(sf, ids_of):
    import pyarrow.parquet as pq

    texts = pq.read_table(f"{sf}/documents.parquet")["text"]
    for encoder in (ENCODER, Encoder(PATH)):
        assert encoder.encode_texts(texts.combine_chunks()) == [np.array(ids_of(t), "<u4").tobytes() for t in texts.to_pylist()]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_store_round_trip(docs, spark, ids_of):
    ws = Workspace(spark, "t")
    manifest = token_store.write_store(spark, docs, ws.uri, PATH)
    got = token_store.read_store(spark, ws.uri, manifest).orderBy("start").collect()
    keys = [r.doc_id for r in got]
    assert keys == sorted((k for k in keys if k is not None)) + [None]
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    want = Counter((r[0], len(ids_of(r[1])) + 1, crc([*ids_of(r[1]), 2])) for r in ROWS)
    assert Counter((r.doc_id, r.n_tokens, zlib.crc32(r.ids)) for r in got) == want
    shard = next(r.path for r in manifest.collect() if token_store.read_document(ws.uri, r.path, 11) is not None)
    assert token_store.read_document(ws.uri, shard, 11).tolist() == [*ids_of(ROWS[7][1]), 2]
    assert token_store.read_document(ws.uri, shard, 12345) is None
    with pytest.raises(ValueError):
        token_store.Shard(open_fs(ws.uri)[0], shard, b"another dictionary")


def test_store_of_nothing(empty, spark):
    assert token_store.stored_tokens(spark, empty, PATH).count() == 0


def check_packing(rows, texts, ids_of, capacity):
    by_row = defaultdict(list)
    for r in rows:
        by_row[r.doc_id].append(r)
    want = Counter()
    for key, text in texts:
        ids, start = [*ids_of(text), 0], 0
        for k, n in enumerate(packing.cut_lengths(len(ids), capacity)):
            assert n == capacity or k == 0
            want[key, k, start, n, crc(ids[start : start + n])] += 1
            start += n
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for pieces in bins.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= capacity
    return len(bins), sum(r.length for r in rows)


def test_packing(docs, empty, spark, ids_of):
    rows = packing.pack_documents(spark, docs, PATH, capacity=64).collect()
    check_packing(rows, [(r[0], r[1]) for r in ROWS], ids_of, 64)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in rows)
    assert packing.pack_documents(spark, empty, PATH).count() == 0


def test_packing_is_tight(spark, sf, ids_of):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    n, tokens = check_packing(entries.op6_best_fit_packing(spark, sf).collect(), texts, ids_of, 2048)
    assert n <= 1.02 * tokens / 2048 + 1


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=15))
def test_plan_places_every_piece_once(histogram):
    plan = packing.plan_bins(histogram, 40)
    placed = Counter()
    for filled, times in plan:
        assert sum(filled) <= 40 and times > 0
        for n in filled:
            placed[n] += times
    assert placed == Counter(histogram)
    runs = packing.place_runs(plan)
    assert {n: int(t[-1, 0]) < histogram[n] for n, t in runs.items()} == dict.fromkeys(histogram, True)


def brute_two_fit(lengths, capacity):
    """Best-two-fit as it is defined on single pieces."""
    left, bins = sorted(lengths), []
    while left:
        room, filled = capacity, []
        while (fits := [x for x in left if x <= room]):
            filled.append(fits[-1])
            left.remove(fits[-1])
            room -= fits[-1]
        small = filled[-1]
        if len(filled) > 1 and room:
            pool = sorted([*left, small])
            sums = [(pool[i] + pool[j], pool[j], pool[i]) for i in range(len(pool)) for j in range(i + 1, len(pool))]
            best = max((s for s in sums if small < s[0] <= room + small), default=None)
            if best:
                filled = [*filled[:-1], *best[1:]]
                left = pool
                left.remove(best[1])
                left.remove(best[2])
        bins.append(sorted(filled, reverse=True))
    return bins


def test_plan_is_best_two_fit():
    rng = random.Random(3)
    for _ in range(150):
        lengths = [rng.randint(1, 30) for _ in range(rng.randint(1, 40))]
        plan = [f for f, times in packing.plan_bins(Counter(lengths), 30) for _ in range(times)]
        want = brute_two_fit(lengths, 30)
        assert sorted(map(sum, plan)) == sorted(map(sum, want)), lengths


@settings(max_examples=100, deadline=None)
@given(st.binary(min_size=0, max_size=900))
def test_media_round_trip(data):
    payload = data.ljust(max(1, -(-len(data) // media.FRAME)) * media.FRAME, b" ")
    stored = media.store_payload(payload)
    fps, frames = media.parse_avi(stored)
    assert fps == media.FPS and media.block_means(frames).tobytes() == payload
    plane = media.decode_jpeg(frames[0])[0].reshape(media.BLOCKS[1], 8, media.BLOCKS[0], 8)
    assert (plane == plane[:, :1, :, :1]).all() and plane[:, 0, :, 0].tobytes() == payload[: media.FRAME]
    without = stored[: stored.rindex(b"idx1")]
    assert media.parse_avi(without)[1] == frames


def test_general_baseline_frame():
    """AC coefficients, two components with their own sampling and restart markers."""
    dc, ac = [(2, s) for s in (0, 1, 2)] + [(3, 3)], [(1, 0), (2, 0x01), (3, 0x11)]
    header = b"\xff\xd8" + media._segment(0xDB, bytes([0, *[2] * 64])) + media._segment(0xC0, bytes([8, 0, 8, 0, 32, 2, 1, 0x21, 0, 2, 0x11, 0]))
    header += media._segment(0xC4, media._huffman(0, dc) + media._huffman(16, ac)) + media._segment(0xDD, b"\0\1") + media._segment(0xDA, bytes([2, 1, 0, 2, 0, 0, 63, 0]))
    d, a = media._codes(dc), media._codes(ac)
    code = lambda t, s: format(t[s][0], f"0{t[s][1]}b")
    block = lambda size, bits: code(d, size) + bits + code(a, 1) + "1" + code(a, 0x11) + "0" + code(a, 0)
    mcu = block(2, "11") + block(1, "0") + block(0, "")
    scan = int(mcu.ljust(-(-len(mcu) // 8) * 8, "1"), 2).to_bytes(-(-len(mcu) // 8), "big").replace(b"\xff", b"\xff\0")
    planes = media.decode_jpeg(header + scan + b"\xff\xd0" + scan + b"\xff\xd9")
    assert planes[0].shape == (8, 32) and planes[1].shape == (8, 16)
    assert (planes[0][:, :16] == planes[0][:, 16:]).all()
    x = np.arange(8)
    want = np.zeros((8, 8))
    for (u, v), value in {(0, 0): 6, (0, 1): 2, (2, 0): -2}.items():  # zigzag places 0, 1 and 3
        scale = lambda k: np.sqrt(0.5) if k == 0 else 1
        want += value * scale(u) * scale(v) / 4 * np.outer(np.cos((2 * x + 1) * u * np.pi / 16), np.cos((2 * x + 1) * v * np.pi / 16))
    assert np.abs(planes[0][:, :8].astype(float) - np.clip(np.rint(want + 128), 0, 255)).max() <= 1


def standard_frame(rng, wide, high, share):
    """A grey frame without Huffman tables, as motion-JPEG has them, and its coefficients in zigzag order."""
    dc, ac = (media._codes(media.standard_tables()[k]) for k in (0x00, 0x10))
    blocks = np.where(rng.random((wide * high, 64)) < share, rng.integers(-40, 40, (wide * high, 64)), 0)
    bits, before = [], 0

    def put(code, size, value):
        bits.append(format(code[0], f"0{code[1]}b"))
        if size:
            bits.append(format(value if value > 0 else value + (1 << size) - 1, f"0{size}b"))

    for block in blocks.tolist():
        diff = block[0] - before
        before = block[0]
        put(dc[abs(diff).bit_length()], abs(diff).bit_length(), diff)
        last = 0
        for at in (k for k in range(1, 64) if block[k]):
            while at - last > 16:
                put(ac[0xF0], 0, 0)
                last += 16
            size = abs(block[at]).bit_length()
            put(ac[(at - last - 1) << 4 | size], size, block[at])
            last = at
        if last < 63:
            put(ac[0], 0, 0)
    joined = "".join(bits)
    joined += "1" * (-len(joined) % 8)
    scan = b"".join(int(joined[k : k + 4096], 2).to_bytes(len(joined[k : k + 4096]) // 8, "big") for k in range(0, len(joined), 4096))
    header = b"\xff\xd8" + media._segment(0xDB, bytes([0, *[2] * 64])) + media._segment(0xC0, bytes([8, *(high * 8).to_bytes(2, "big"), *(wide * 8).to_bytes(2, "big"), 1, 1, 0x11, 0]))
    return header + media._segment(0xDA, bytes([1, 1, 0, 0, 63, 0])) + scan.replace(b"\xff", b"\xff\0") + b"\xff\xd9", blocks


def test_frames_without_tables_use_the_standard_ones():
    data, blocks = standard_frame(np.random.default_rng(3), 5, 4, 0.2)
    plane = media.decode_jpeg(data)[0]
    x = np.arange(8)
    cosines = np.array([(np.sqrt(0.5) if u == 0 else 1) * np.cos((2 * x + 1) * u * np.pi / 16) / 2 for u in range(8)])
    for k, block in enumerate(blocks):
        want = sum(2 * value * np.outer(cosines[u], cosines[v]) for value, (u, v) in zip(block, media.zigzag()))
        got = plane[k // 5 * 8 : k // 5 * 8 + 8, k % 5 * 8 : k % 5 * 8 + 8]
        assert np.abs(got - np.clip(np.rint(want + 128), 0, 255)).max() <= 1


def test_frame_of_a_megabyte():
    data, _ = standard_frame(np.random.default_rng(4), 160, 120, 0.65)
    assert len(data) > 1_000_000
    began = time.process_time()
    assert media.decode_jpeg(data)[0].shape == (960, 1280)
    assert time.process_time() - began < 60


def test_open_index_over_parts():
    """Frames of an AVIX part are found by the super index, and by walking where there is no index."""
    payload = bytes(range(192)) * 5
    frames = media.encode_frames(payload)
    chunk = media._chunk
    first, second = (chunk(b"LIST", b"movi" + b"".join(chunk(b"00dc", f) for f in some)) for some in (frames[:3], frames[3:]))

    def built(places):
        parts = []
        for base, some in zip(places, (frames[:3], frames[3:])):
            at = base + 12 + np.cumsum([0, *[len(f) + len(f) % 2 + 8 for f in some]])
            entries = b"".join(struct.pack("<II", a + 8, len(f)) for a, f in zip(at.tolist(), some))
            parts.append(chunk(b"ix00", struct.pack("<HBBI4sQI", 2, 0, 1, len(some), b"00dc", 0, 0) + entries))
        return parts

    indexes = built((0, 0))
    head = lambda a, b: chunk(b"LIST", b"hdrl" + chunk(b"LIST", b"strl" + chunk(b"indx", struct.pack("<HBBI4sQI", 4, 0, 0, 2, b"00dc", 0, 0) + struct.pack("<QIIQII", a, 32, 3, b, 32, 2))))
    size = 12 + len(head(0, 0))
    places = (size, size + len(first) + len(indexes[0]) + 12)
    indexes = built(places)
    data = lambda top: chunk(b"RIFF", b"AVI " + top + first + indexes[0]) + chunk(b"RIFF", b"AVIX" + second + indexes[1])
    whole = data(head(places[0] + len(first), places[1] + len(second)))
    assert media.parse_avi(whole)[1] == frames
    assert media.parse_avi(data(b""))[1] == frames
    assert media.block_means(frames).tobytes() == payload


def test_shots_find_cuts():
    rng = np.random.default_rng(1)
    scenes = [rng.integers(a, a + 8, (n, 192)) for a, n in ((0, 30), (120, 20), (200, 25))]
    assert media.shots(np.concatenate(scenes)) == [(0, 30), (30, 50), (50, 75)]
    assert media.shots(np.zeros((0, 192), np.uint8)) == [] and media.shots(np.zeros((1, 192), np.uint8)) == [(0, 1)]


def test_media_columns(docs, empty, spark):
    stored = media.text_to_media(docs)
    rows = media.media_features(stored).collect()
    want = Counter()
    for key, text, *_ in ROWS:
        n, payload = media.payload_of(text)
        want[key, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows) == want
    assert len({(r.media_sha256, r.feature) for r in rows if r.doc_id == 7}) == 1
    timed = media.clips(stored).collect()
    assert {r.doc_id for r in timed} == {r[0] for r in ROWS} and all(r.start_ms < r.end_ms for r in timed)
    broken = spark.createDataFrame([(1, b"junk"), (2, None)], "doc_id long, media binary")
    assert [r.start_ms for r in media.clips(broken).collect()] == [None, None]
    assert media.media_features(media.text_to_media(empty)).count() == 0
    odd = [(1, 0, b"junk"), (2, None, None), (3, 1, media.store_payload(b"x" * 192)), (3, 1, media.store_payload(b"x" * 192)), (4, 0, media.write_avi([], 128, 96)), (5, 9, media.store_payload(b"y" * 192)[:-300])]
    got = [tuple(r)[1:] for r in media.media_features(spark.createDataFrame(odd, "doc_id long, n_bytes long, media binary").coalesce(1)).collect()]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert got[0] == (0, None, None, None, 4, sha(b"junk"), None) and got[1] == (None,) * 7
    assert got[2] == got[3] and got[2][1:4] == (192, sha(b"x" * 192), zlib.crc32(b"x" * 16)) and got[2][6].startswith("frames=1;shots=1;longest_ms=40;")
    assert got[4][1:4] == (0, sha(b""), 0) and len(got) == 6 and got[5][4] == len(odd[5][2])


def brute_top_k(rows, every, k=5, scale=256):
    good = [(i, q) for i, v in rows if i is not None and (q := topk.quantised(v, scale)) is not None]
    out = {}
    for i, q in good:
        if i % every == 0:
            scored = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(q, p)))), j) for j, p in good if j != i)[:k]
            out |= {(i, rank): (j, -s) for rank, (s, j) in enumerate(scored, 1)}
    return out


def test_top_k(spark):
    rng = np.random.default_rng(6)
    rows = [(k, [float(x) for x in rng.normal(0, 0.2, 8)]) for k in range(300)]
    rows += [(k, [0.5] * 8) for k in range(300, 360)]  # ties
    rows += [(1000, None), (1050, [1.0, None]), (1051, [float("nan")]), (1100, [float("inf")]), (None, [1.0]), (1150, []), (1200, [1e15] * 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = topk.top_k(spark, df, every=50, query_rows=4, candidate_rows=37).collect()
    assert {(r.query_id, r.rank): (r.vec_id, r.score) for r in got} == brute_top_k(rows, 50)


def test_phases_two_and_three_complete_what_they_collect():
    """Every entry at or above the cutoff, with its whole score; few partial scores where lengths differ."""
    rng = np.random.default_rng(11)
    q = rng.integers(-256, 256, (6, 16))
    c = rng.integers(-256, 256, (300, 16)) * np.where(np.arange(300) < 60, 100, 1)[:, None]
    c[:, 8:] //= np.where(np.arange(300) < 30, 50, 1)[:, None]
    whole = q @ c.T
    for cutoffs in ([int(np.sort(row)[-5]) for row in whole], [-(10**6)] * 6, [None, *[0] * 5]):
        places, scores, work = topk.collected(q, c, cutoffs, 4)
        for i in range(6):
            assert (scores[i] == whole[i, places[i]]).all()
            assert set(np.flatnonzero(whole[i] >= (-(1 << 62) if cutoffs[i] is None else cutoffs[i]))) <= set(places[i])
    assert topk.collected(q, c, [int(np.sort(row)[-5]) for row in whole], 4)[2] < 6 * 300 * 4 / 4


def test_top_k_few_and_none(spark):
    schema = "vec_id long, embedding array<float>, score long, data binary"
    few = spark.createDataFrame([(0, [1.0], 1, None), (50, [2.0], 1, None)], schema)
    assert sorted(tuple(r) for r in topk.top_k(spark, few, every=50).collect()) == [(0, 1, 50, 131072), (50, 1, 0, 131072)]
    assert topk.top_k(spark, spark.createDataFrame([], schema)).count() == 0
    assert topk.top_k(spark, spark.createDataFrame([(0, [1.0], 1, None)], schema)).count() == 0


def test_url_rules(spark):
    pages = [(1, "http://A.Example.COM/en/71?x"), (2, None), (3, "no scheme"), (4, "http://com/en/"), (5, "http://xcom/en/"), (6, "x://y.net/de/8#a"), (7, "x://example.net/de/8"), (7, "x://example.net/de/8"), (8, "http://"), (9, "a://b://c.org/es/"), (10, "h://notexample.com/en/7"), (None, "http://k.org/es/1\n2")]
    df = spark.createDataFrame([(*p, "x", "y") for p in pages], "page_id long, url string, host string, verdict string")
    got = Counter(map(tuple, url_rules.judge_urls(spark, df, entries.RULES).collect()))
    want = Counter()
    for key, url in pages:
        host, path = url_rules.split_url(url)
        fits = [r for r in entries.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.text), default=None)
        want[key, host, path, best and best.text, best.verdict if best else "allow"] += 1
    assert got == want
    assert url_rules.judge_urls(spark, df.limit(0), entries.RULES).count() == 0
    assert {r.verdict for r in url_rules.judge_urls(spark, df, [], "block").collect()} == {"block"}


def test_digest_collisions_are_confirmed(tmp_path, monkeypatch):
    monkeypatch.setattr(url_rules.xxhash, "xxh64_intdigest", lambda s: 7)
    array = url_rules.DigestArray(url_rules.write_array(entries.RULES, str(tmp_path)))
    assert array.judge([("example.com", "/en/7"), ("a.net", "/de/1"), ("a.net", "/fr/")]) == [("example.com/en/7", "allow"), ("net/de/", "allow"), (None, None)]


PAGES = [(3, "http://a/\r\nb", "same"), (1, "http://b/", "same"), (2, None, "same"), (4, "u", None), (5, "u", ""), (6, "u", "é" * 1000), (7, "u", "\r\n\r\nWARC/1.1"), (None, "u", "same"), (8, "u", "twice"), (8, "u", "twice")]


@pytest.mark.parametrize("least", [0, 5])
def test_warc_round_trip(spark, least):
    pages = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, first string").repartition(3)
    got = Counter(map(tuple, warc.archived_pages(spark, pages, least_bytes=least).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "html").collect()))
    want = Counter()
    for key, _, html in PAGES:
        data = (html or "").encode()
        first = min((k for k, _, h in PAGES if (h or "") == (html or "") and k is not None), default=None)
        again = len(data) >= least and key != first
        want[key, len(data), warc.payload_digest(data), "revisit" if again else "response", first if again else None, None if again else html or ""] += 1
    assert got == want


def test_warc_of_nothing(spark):
    assert warc.archived_pages(spark, spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_archive_begins_with_its_dictionary(spark, sf):
    ws = Workspace(spark, "t")
    archives = warc.write_archives(spark, spark.read.parquet(f"{sf}/pages.parquet"), ws.uri).collect()
    with open(archives[0].path, "rb") as f:
        data = f.read()
    assert data[:4] == (0x184D2A5D).to_bytes(4, "little")


def test_dictionary_of_few_samples():
    for samples in ([], [b""], [b"abc"], [b"x" * 100_000]):
        d = zdict.train(samples)
        assert zdict.decompressor(d).decompress(zdict.compressor(d).compress(b"abcabc")) == b"abcabc"
