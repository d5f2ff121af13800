"""Perspective rotation, WARC archives, and the SQL of the queries that have some."""

import gzip
import hashlib
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from offerflow.llm import chat, queries, warc

from .conftest import SF, ordered


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    found = queries.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    expected = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert ordered(map(tuple, found.select(*columns).collect())) == ordered(expected)


def test_all_queries():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{k}" for k in range(1, 14)]


# Perspectives


def brute_rotation(rows, size):
    size = size or 1 << 30
    turns, speakers = defaultdict(list), defaultdict(set)
    for conv, turn, role, text in rows:
        role = "unknown" if role is None else role
        turns[conv].append((turn is not None, turn, role, text or ""))
        speakers[conv].add(role)
    out = []
    for conv, said in turns.items():
        said.sort()
        for part in range(0, len(said), size):
            some = said[part : part + size]
            for who in speakers[conv]:
                text, spans = "", []
                for _, _, role, t in some:
                    t = t.replace("<|", "<||")
                    text += "<|assistant|>\n" if role == who else "<|user:" + re.sub(r"[%|<>\r\n]", lambda m: f"%{ord(m[0]):02X}", role) + "|>\n"
                    if role == who:
                        spans.append(f"{len(text)}:{len(text) + len(t) + 7}")
                    text += t + "<|end|>\n"
                out.append((conv, part // size, who, len(some), sum(r == who for _, _, r, _ in some), text, ",".join(spans)))
    return ordered(out)


def test_rotation(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in turns.collect()]
    for size in (None, 3):
        assert ordered(map(tuple, chat.rotate_perspectives(turns, size).collect())) == brute_rotation(rows, size)


def test_rotation_of_odd_turns(spark):
    rows = [(1, 0, "ann", "hi"), (1, 1, "bob", None), (1, 1, "bob", None), (1, 2, None, ""), (1, None, "ann", "before"), (1, 9, "cid", "x" * 9000), (None, 0, "ann", "who"), (None, 1, "eve", "me"), (2, 0, "assistant", "alone"), (3, -1, "ann", "early"), *((4, 5, f"p{k % 5}", f"t{k}") for k in range(40))]
    rows += [(5, 60 + k, "ab"[k % 2], f"turn {k}") for k in range(10)]  # across a step of turn numbers
    rows += [(6, 0, "eve|>\n<|assistant", "fine <|end|>\n<|user:ann|>\nno"), (6, 1, "ann", "<||a<|<|")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("clash") for c in ("chunk", "part", "said", "of", "perspective", "pieces", "number", "mask", "step", "place", "n", "within", "above", "of_step")})
    for size in (4, None):
        assert ordered(map(tuple, chat.rotate_perspectives(turns, size).collect())) == brute_rotation(rows, size)
    whole = [r for r in chat.rotate_perspectives(turns).collect() if r.conv_id in (5, 6)]
    assert len(whole) == 4 and all(r.text.count("<|end|>\n") == r.n_turns for r in whole)
    assert chat.rotate_perspectives(turns.limit(0)).count() == 0


def test_names_that_look_alike_get_labels_of_their_own(spark):
    names = ["a|b", "a<b", "a_b", "a>b", "a%7Cb", "a\nb", "ann"]
    turns = spark.createDataFrame([(1, k, n, "hi") for k, n in enumerate(names)], "conv_id long, turn long, role string, text string")
    texts = {r.perspective: r.text for r in chat.rotate_perspectives(turns).collect()}
    assert len(set(re.findall(r"<\|user:([^|]*)\|>", texts["ann"]))) == 6


def test_a_long_dialogue_is_one_row(spark):
    turns = spark.range(3000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "ann").otherwise("bob").alias("role"), F.lit("so").alias("text"))
    assert [(r.part, r.n_turns, r.n_targets) for r in chat.rotate_perspectives(turns).collect()] == [(0, 3000, 1500)] * 2
    assert chat.rotate_perspectives(turns, 1000).count() == 6


def test_the_mask_covers_what_the_assistant_says(spark):
    turns = spark.createDataFrame([(1, 0, "ann", "naïve 🙂"), (1, 1, "bob", "漢字"), (1, 2, "ann", "bye")], "conv_id long, turn long, role string, text string")
    for r in chat.rotate_perspectives(turns).collect():
        said = [r.text[int(a) : int(b)] for a, b in (s.split(":") for s in r["mask"].split(","))]
        assert said == {"ann": ["naïve 🙂<|end|>", "bye<|end|>"], "bob": ["漢字<|end|>"]}[r.perspective]
        assert f"<|user:{r.perspective}|>" not in r.text


def test_rotation_is_native(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    plan = chat.rotate_perspectives(turns)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# WARC


def brute_archive(rows):
    digest = lambda h: hashlib.sha256((h or "").encode()).hexdigest()
    first = {}
    for i, h in rows:
        if len((h or "").encode()) >= 100 and i is not None:
            first[digest(h)] = min(i, first.get(digest(h), i))
    out = []
    for i, h in rows:
        to = first.get(digest(h))
        revisit = to is not None and i != to
        out.append((i, len((h or "").encode()), digest(h), "revisit" if revisit else "response", to if revisit else None))
    return ordered(out)


def odd_pages(spark):
    long, copy = "".join(f"<p>{k}" for k in range(60_000)), "é" * 60
    rows = [(1, long), (2, long), (3, copy), (4, copy), (2, long), (5, "short"), (6, "short"), (7, None), (8, ""), (9, "a" * 99), (10, "a" * 99), (11, "b" * 100), (12, "b" * 100), (None, "c" * 200), (None, copy), (13, "\x00\r\n\r\n" * 80), (14, "x" * (3 * warc.CHUNK)), (15, "x" * (3 * warc.CHUNK + 1)), (16, "y" * 150), (16, "y" * 150), (17, "y" * 150)]
    df = spark.createDataFrame([(i, None if k % 5 == 0 else f"http://x/{k}\r\nX: y", h) for k, (i, h) in enumerate(rows)], "page_id long, url string, html string")
    return rows, df.withColumns({c: F.lit("clash") for c in ("digest", "size", "first", "record_id", "chunk_no", "of_page", "record_type", "refers_to")})


def test_archive_of_odd_pages(spark):
    rows, df = odd_pages(spark)
    found = ordered((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archive_pages(df.repartition(5)).collect())
    assert found == brute_archive(rows)
    assert warc.archive_pages(df.limit(0)).count() == 0


def test_chunks_are_a_warc_stream(spark, tmp_path):
    rows, df = odd_pages(spark)
    target = f"file://{tmp_path}/archive"
    warc.write_archive(df, target)
    records = defaultdict(list)
    for r in spark.read.parquet(target).collect():
        records[r.record_id].append(r)
    assert len(records) == len(rows)
    payloads = Counter()
    for chunks in records.values():
        chunks.sort(key=lambda r: r.chunk_no)
        assert [r.chunk_no for r in chunks] == list(range(chunks[0].n_chunks)) and all(len(gzip.decompress(r.data)) <= warc.CHUNK + 1000 for r in chunks)
        head, _, body = gzip.decompress(b"".join(r.data for r in chunks)).partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\n") and body.endswith(b"\r\n\r\n") and len(body) - 4 == int(fields["Content-Length"])
        if fields["WARC-Type"] == "response":
            assert fields["WARC-Payload-Digest"] == "sha256:" + hashlib.sha256(body[:-4]).hexdigest() == "sha256:" + chunks[-1].digest_so_far
            payloads[body[:-4]] += 1
        else:
            assert body == b"\r\n\r\n" and {"WARC-Refers-To-Target-URI", "WARC-Refers-To-Date", "WARC-Profile"} <= set(fields)
            if "WARC-Refers-To" in fields:
                first = gzip.decompress(records[fields["WARC-Refers-To"][10:-1]][0].data)
                assert fields["WARC-Payload-Digest"].encode() in first and b"WARC-Type: response" in first
    assert set(payloads) == {(h or "").encode() for _, h in rows}


def test_damage_is_found(spark, tmp_path):
    _, df = odd_pages(spark)
    target = f"file://{tmp_path}/archive"
    warc.write_archive(df.filter("page_id = 14"), target)
    chunks = spark.read.parquet(target).withColumn("digest_so_far", F.when(F.col("chunk_no") == 1, "0").otherwise(F.col("digest_so_far")))
    chunks.write.parquet(f"file://{tmp_path}/damaged")
    with pytest.raises(Exception, match="damaged chunk"):
        warc.read_archive(spark, f"file://{tmp_path}/damaged").collect()
