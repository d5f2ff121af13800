"""Media columns, token files, token counts, packing."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from offerflow.llm import jpeg, packing, rans, tokencount
from offerflow.llm.tokens import encoder, vocabulary_path

from .conftest import ordered, pairs

WORD, BYTE = vocabulary_path("word_bpe_49k.json"), vocabulary_path("byte_bpe_50k.json")


def library_ids(path, text):
    from tokenizers import Tokenizer

    if path not in library_ids.loaded:
        library_ids.loaded[path] = Tokenizer.from_file(path)
    return library_ids.loaded[path].encode(text or "", add_special_tokens=False).ids


library_ids.loaded = {}


# Token ids


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_ids_are_those_of_the_library(path, documents, odd_documents):
    enc = encoder(path)
    for _, text in pairs(documents) + pairs(odd_documents):
        assert np.frombuffer(enc.encode(text or ""), enc.dtype).tolist() == library_ids(path, text)


@pytest.mark.parametrize("path", [WORD, BYTE])
@settings(max_examples=150, deadline=None)
@given(text=st.text(alphabet=st.sampled_from(list("aAbIİıſéÉ 's\n\t.,!?0129_-<|> ‍漢字é́ßK🙂")), max_size=40))
def test_ids_of_any_text(path, text):
    enc = encoder(path)
    for _ in range(2):  # the second time from the cache
        assert np.frombuffer(enc.encode(text), enc.dtype).tolist() == library_ids(path, text)


# Media


def brute_media(text):
    data = (text or "").encode()
    padded = data + b"\xff" * (max(1, -(-len(data) // 576)) * 576 - len(data))
    return len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:])


@pytest.mark.parametrize("name", ["documents", "odd_documents"])
def test_media_holds_the_payload(name, request):
    df = request.getfixturevalue(name)
    found = [(r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in jpeg.jpeg_media(df).collect()]
    assert ordered(found) == ordered((i, *brute_media(t)) for i, t in pairs(df))


def test_media_of_equal_texts_are_equal(odd_documents):
    rows = {r.doc_id: r for r in jpeg.jpeg_media(odd_documents).collect() if r.doc_id in (1, 2)}
    assert (rows[1].media_sha256, rows[1].feature) == (rows[2].media_sha256, rows[2].feature)
    assert rows[1].feature.split(":")[0] == "192x192"  # 24 x 24 blocks of 8 x 8


def test_no_media_of_no_documents(no_documents):
    assert jpeg.jpeg_media(no_documents).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.lists(st.binary(max_size=3000), min_size=1, max_size=4))
def test_jpeg_round_trip(payloads):
    padded = [jpeg.pad_payload(p) for p in payloads]
    assert [b"".join(t.tobytes() for t in ts) for ts in jpeg.decode_luminance(jpeg.encode_payload(padded))] == padded


def test_long_payloads_are_several_images():
    data = random.Random(3).randbytes(jpeg.FRAME + 576)
    (images,) = jpeg.decode_luminance(jpeg.encode_payload([data]))
    assert len(images) == 2 and b"".join(t.tobytes() for t in images) == data


def bits_of(diff, codes):
    size = abs(diff).bit_length()
    return codes[size] + (format(diff if diff > 0 else diff + (1 << size) - 1, f"0{size}b") if size else "")


def colour_jpeg(luma, width, height):
    """A three-component image with 2 x 2 luminance blocks in a unit and one AC coefficient in each: written bit by bit."""
    codes = [format(k, "04b") for k in range(12)]
    segment = lambda m, b: bytes([0xFF, m]) + (len(b) + 2).to_bytes(2, "big") + b
    out, last = "", [0, 0, 0]
    for unit in luma:
        for k, levels in ((0, unit), (1, [5]), (2, [-3])):
            for level in levels:
                out += bits_of(level - last[k], codes)
                last[k] = level
                out += "0" + "1" + "10"  # one coefficient of size 1, value 1; end of block
    out += "1" * (-len(out) % 8)
    scan = bytes(int(out[i : i + 8], 2) for i in range(0, len(out), 8)).replace(b"\xff", b"\xff\0")
    dc = bytes([0x00, 0, 0, 0, 12, *[0] * 12, *range(12)])
    ac = bytes([0x10, 1, 1, *[0] * 14, 0x01, 0x00])
    frame = bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    return b"\xff\xd8" + segment(0xDB, bytes([0, 16, *[1] * 63])) + segment(0xC0, frame) + segment(0xC4, dc) + segment(0xC4, ac) + segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + scan + b"\xff\xd9"


def test_colour_with_sampling():
    luma = [[1, 2, 3, 4], [10, 20, 30, 40]]
    ((thumbnail,),) = jpeg.decode_luminance([colour_jpeg(luma, 32, 16)])
    expected = np.array([[1, 2, 10, 20], [3, 4, 30, 40]]) * 16 / 8 + 128
    assert np.abs(thumbnail.astype(int) - expected).max() <= 1


def test_only_baseline_is_read():
    data = bytearray(jpeg.encode_payload([jpeg.pad_payload(b"x")])[0])
    data[data.index(b"\xff\xc0") + 1] = 0xC2
    with pytest.raises(ValueError, match="baseline"):
        jpeg.decode_luminance([bytes(data)])


# Token files


def brute_digests(rows, path, end):
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = [*library_ids(path, text), end]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_files(documents):
    found = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rans.token_digests(documents, WORD).collect()]
    assert ordered(found) == brute_digests(pairs(documents), WORD, 2)


def test_token_files_of_odd_documents(odd_documents):
    found = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rans.token_digests(odd_documents, WORD).collect()]
    expected = brute_digests(pairs(odd_documents), WORD, 2)
    # Rows with one id may come in either order; places still follow each other.
    assert Counter((i, n, c) for i, _, n, c in found) == Counter((i, n, c) for i, _, n, c in expected)
    places = sorted((s, n) for _, s, n, _ in found)
    assert [s for s, _ in places] == np.cumsum([0, *(n for _, n in places[:-1])]).tolist()
    assert [i for i, *_ in sorted(found, key=lambda r: r[1])] == [i for i, *_ in expected]


def test_no_token_files(no_documents):
    assert rans.token_digests(no_documents, WORD).count() == 0


@settings(max_examples=40, deadline=None)
@given(seed=st.integers(0, 1 << 30), n=st.integers(0, 40_000), kinds=st.integers(1, 3000))
def test_coder_round_trip(seed, n, kinds):
    rng = np.random.default_rng(seed)
    ids = np.minimum(rng.geometric(min(0.9, 20 / kinds), n) - 1, kinds - 1)
    counts = np.bincount(ids, minlength=kinds)
    model = rans.Model(rans.frequencies(counts))
    lengths = np.array([n], np.int64)
    block = rans.pack_block([None], lengths, ids, model)
    doc_ids, found, back = rans.unpack_block(block, model)
    assert doc_ids == [None] and found.tolist() == [n] and np.array_equal(back, ids)
    with pytest.raises(ValueError):
        rans.unpack_block(block[:-5] + bytes([block[-5] ^ 1]) + block[-4:], model)


def test_frequencies_sum_up():
    counts = np.array([10**12, 1, 0, 5, *[1] * 40_000])
    scaled = rans.frequencies(counts)
    assert scaled.sum() == 1 << rans.SCALE and (scaled[counts > 0] > 0).all() and scaled[2] == 0


# Token counts


@pytest.mark.parametrize("name", ["documents", "odd_documents", "no_documents"])
def test_token_counts(name, request):
    df = request.getfixturevalue(name)
    found = [tuple(r) for r in tokencount.count_tokens(df, WORD).collect()]
    expected = [(i, len((t or "").encode()), n := len(library_ids(WORD, t)), n > 2048) for i, t in pairs(df)]
    assert ordered(found) == ordered(expected)


def test_only_misses_are_encoded(spark, documents, odd_documents, tmp_path):
    cache = f"file://{tmp_path}/cache"
    tokencount.count_tokens(documents, WORD, cache).collect()
    stored = spark.read.parquet(cache)
    before = stored.count()
    assert before == len({t or "" for _, t in pairs(documents)}) == stored.select("digest").distinct().count()
    tokencount.count_tokens(documents, WORD, cache).collect()
    assert spark.read.parquet(cache).count() == before
    both = documents.unionByName(odd_documents.select(documents.columns))
    found = [tuple(r)[:3] for r in tokencount.count_tokens(both, WORD, cache).collect()]
    assert len(found) == both.count() and spark.read.parquet(cache).count() == len({t or "" for _, t in pairs(both)})
    tokencount.count_tokens(documents, BYTE, cache).collect()  # another tokenizer has counts of its own
    assert spark.read.parquet(cache).select("version").distinct().count() == 2


# Packing


def check_packing(df, length, window, targets=None):
    out = packing.pack(df, BYTE, 1, length, window, keep_ids=True, targets=targets).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in out:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length and r.length > 0
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    expected = Counter((i, tuple([*library_ids(BYTE, t), 1])) for i, t in pairs(df))
    total = sum(len(k[1]) * n for k, n in expected.items())
    # Each document's ids are its pieces', one after the other; ids that repeat are told apart by their order.
    texts = defaultdict(list)
    for (i, ids), n in expected.items():
        texts[i] += [ids] * n
    for i, pieces in by_doc.items():
        assert sum(p.length for p in pieces) == sum(map(len, texts[i]))
        if len(texts[i]) == 1:
            pieces.sort(key=lambda p: p.start)
            assert [p.start for p in pieces] == np.cumsum([0, *(p.length for p in pieces[:-1])]).tolist()
            assert np.frombuffer(b"".join(p.ids for p in pieces), "<u4").tolist() == list(texts[i][0])
            assert {p.doc_tokens for p in pieces} == {len(texts[i][0])}
    assert set(by_doc) == set(texts)
    for pieces in by_sequence.values():
        pieces.sort(key=lambda p: p.offset)
        assert [p.offset for p in pieces] == np.cumsum([0, *(p.length for p in pieces[:-1])]).tolist()
    sizes = [sum(p.length for p in pieces) for _, pieces in sorted(by_sequence.items())]
    assert sorted(by_sequence) == list(range(-(-total // length))) and all(s == length for s in sizes[:-1])
    return out, total


def test_packing(documents):
    check_packing(documents, 2048, 64 * 2048)


def test_packing_odd_documents(odd_documents):
    check_packing(odd_documents, 256, 1024)


def test_nothing_to_pack(no_documents):
    assert packing.pack(no_documents, BYTE).count() == 0


def test_every_window_has_the_mixture(documents):
    length, window = 256, 4096
    out, total = check_packing(documents, length, window)
    source = {r.doc_id: r.source for r in documents.collect()}
    whole = Counter()
    for r in out:
        whole[source[r.doc_id]] += r.length
    n_windows = -(-total // window)
    sent, at = Counter(), 0
    share = {s: n / total for s, n in whole.items()}
    tokens = sorted((r.sequence_id * length + r.offset, r.length, source[r.doc_id]) for r in out)
    marks = iter([round(total * (w + 1) / n_windows) for w in range(n_windows)])
    mark = next(marks)
    for start, n, s in tokens:
        sent[s] += n
        at = start + n
        if at >= mark - len(whole):
            for k in whole:  # a queue is never further from its target than a token, or what a piece across the mark adds
                assert abs(sent[k] - share[k] * at) <= n + len(whole) + 1
            mark = next(marks, 1 << 62)


@pytest.mark.parametrize("shares", [(0.5, 0.2), (0.9, 0.1), (0.05, 0.05), (0.0, 0.6)])
def test_windows_have_the_target_shares(documents, shares):
    """In every window each queue is within a token of its share among those that are not empty yet."""
    length, window = 256, 4096
    docs = documents.repartition(5)
    targets = dict(zip([s for s, _ in Counter(r.source for r in documents.collect()).most_common(2)], shares))
    check_packing(docs, length, window, targets)
    staged = packing.stage_tokens(docs, BYTE, 1).withColumn("source", F.when(F.col("source").isin(*targets), F.col("source")).otherwise(packing.REST))
    placed = packing.queue_places(staged.select("row", "doc_id", "source", "n_tokens", "digest"))
    totals = {r.source: r["sum(n_tokens)"] for r in staged.groupBy("source").sum("n_tokens").collect()}
    sizes = {(r.window, r.source): r.size for r in packing.fill_windows(packing.in_phases(placed, targets, window)).groupBy("window", "source").agg(F.sum("size").alias("size")).collect()}
    rates = targets | {packing.REST: 1 - sum(shares)}
    left, phases = Counter(totals), packing.phases(totals, targets, window)
    for first in sorted({p[3] for p in phases}):
        now = [p for p in phases if p[3] == first]
        active = {q: rates[q] for q, n in left.items() if n > 0 and rates[q] > 0} or {q: 1 for q, n in left.items() if n > 0}
        size = sum(end - begin for _, begin, end, *_ in now)
        for q, begin, end, _, n_windows in now:
            assert abs((end - begin) - size * active[q] / sum(active.values())) <= 2
            for w in range(n_windows):
                assert abs(sizes.get((first + w, q), 0) - (end - begin) / n_windows) <= 1
            left[q] -= end - begin
    assert not +left and sum(sizes.values()) == sum(totals.values())


def test_phases_carry_deficits():
    found = packing.phases({"a": 1000, "b": 100, packing.REST: 333}, {"a": 1 / 3, "b": 0.5}, 64)
    for queue, total in (("a", 1000), ("b", 100), (packing.REST, 333)):
        parts = [(begin, end) for q, begin, end, *_ in found if q == queue]
        assert parts[0][0] == 0 and parts[-1][1] == total and all(x[1] == y[0] for x, y in zip(parts, parts[1:]))
    with pytest.raises(ValueError):
        packing.phases({"a": 1}, {"a": 0.7, "b": 0.7}, 64)
