"""The prefix trie of conversations, languages and the divergence of sources, against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from offerflow.llm import divergence, langid, prefixtrie, queries

from .conftest import SF, ordered

# Prefix trie


def brute_trie(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    said = {c: [t[2:] for t in sorted(ts)] for c, ts in turns.items()}
    members = defaultdict(list)
    for c in said:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        seq = tuple(said.get(base, [])[:h] + said[c][h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].append((c, len(seq) == d))
    children, leaves, saved = Counter(), Counter(), Counter()
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, m in members.items():
        size = len(p[-1][1].encode()) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * size
            leaves[p[:d]] += children[p] == 0
    least = {p: min(c for c, _ in m) for p, m in members.items()}
    ends = lambda m: hashlib.sha256(",".join(map(str, sorted(c for c, e in m if e))).encode()).hexdigest()
    return ordered((least[p], len(p), least[p[:-1]] if p else None, len(m), children[p], leaves[p], saved[p], ends(m)) for p, m in members.items())


def trie_of(turns, **how):
    return ordered(map(tuple, prefixtrie.prefix_trie(turns, **how).collect()))


def test_trie(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = [tuple(r) for r in turns.select("conv_id", "turn", "role", "text").collect()]
    assert trie_of(turns) == brute_trie(rows) == trie_of(turns, block=2, fan=2)


def test_trie_of_odd_turns(spark):
    rnd = random.Random(5)
    rows = [(c, k, "ab"[rnd.random() < 0.3], "xyz"[rnd.random() < 0.4]) for c in range(-12, 60) for k in range(rnd.randrange(1, 12))]
    rows += [(70, None, None, "first"), (70, 0, "u", None), (70, 0, "a", "tie"), (70, 0, "a", "tie"), (None, 0, "u", "nobody"), (77, 3, "u", "alone"), (80, 0, "", ""), (81, 0, "u", "ü" * 5000)]
    rows += [(c, k, "u", "same") for c in range(100, 130) for k in range(3)]  # copies
    rows += [(c, k, "u", f"turn {k}") for c in (205, 210) for k in range(150)]  # long ones with a common beginning
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("clash") for c in ("of", "key", "seq", "part", "place", "step", "head", "h", "own", "depth", "token", "block")})
    expected = brute_trie(rows)
    assert trie_of(turns) == expected
    assert trie_of(turns, block=3, fan=2) == expected
    assert prefixtrie.prefix_trie(turns.limit(0)).count() == 0
    alone = turns.filter("conv_id = 77")
    assert [tuple(r) for r in prefixtrie.prefix_trie(alone).collect()] == brute_trie([(77, 3, "u", "alone")])


def test_outlines_are_short():
    """What a block passes on does not grow with its classes."""
    token = lambda k: hashlib.sha256(b"%d" % k).digest()[:16] + (1).to_bytes(8, "big")
    rnd = random.Random(1)
    classes = sorted({b"".join(token(rnd.randrange(3)) for _ in range(rnd.randrange(9))) for _ in range(3000)})
    outline = prefixtrie.Outline()
    lcp = [prefixtrie.shared(a, b) for a, b in zip(classes, classes[1:])]
    for seq, value in zip(classes[100:2000], lcp[99:]):
        list(outline.add(value, 1, prefixtrie.Run(1, 0, 0, 0, 1, seq, value)))
    assert len(outline.items()) <= 4 * 9


# Languages


def brute_vector(text, dimensions):
    """Loops over the definition."""
    low = "".join(c if c.isalpha() else " " for c in text.lower())
    symbols = [0] + [0 if c == " " else ord(c) for c in re.sub(" +", " ", f" {low} ").strip()] + [0]
    vector = lambda c: langid.symbol_vectors(np.array([c]), dimensions)[0].tolist()
    known = {c: vector(c) for c in set(symbols)}
    total = [0] * dimensions
    for a, b, c in zip(symbols, symbols[1:], symbols[2:]):
        for k in range(dimensions):
            total[k] += known[a][k - 2] * known[b][k - 1] * known[c][k]
    return total


def held(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 4 == 2


def test_languages_by_brute_force(spark, odd_documents):
    dimensions = 64
    docs = odd_documents.filter("length(text) < 300 or text is null")
    rows = [(r.doc_id, r.text, r.lang) for r in docs.select("doc_id", "text", "lang").collect()]
    sums = defaultdict(lambda: np.zeros(dimensions, np.int64))
    for doc_id, text, lang in rows:
        if text is not None and lang is not None and not held(doc_id):
            sums[lang] += brute_vector(text, dimensions)
    got = {}
    for r in langid.identify_languages(docs, dimensions).collect():
        got.setdefault((r.doc_id, r.held_out, r.lang_pred, round(r.score, 9)), 0)
        got[r.doc_id, r.held_out, r.lang_pred, round(r.score, 9)] += 1
    expected = Counter()
    for doc_id, text, _ in rows:
        if not text or not any(c.isalpha() for c in text):
            expected[doc_id, held(doc_id), "und", 0.0] += 1
            continue
        v = np.array(brute_vector(text, dimensions), float)
        best = max((round(float(v @ p / np.sqrt(v @ v) / np.sqrt(p @ p)), 9), name) for name, p in sums.items())
        expected[doc_id, held(doc_id), best[1], max(best[0], 0.0)] += 1
    assert got == dict(expected)


def test_long_texts_in_pieces(monkeypatch):
    text = "Straße und İstanbul, 漢字 — the end. " * 300
    whole = langid.bundle([text, "ab"], [0, 1], 2, 128)[0]
    monkeypatch.setattr(langid, "PIECE", 97)
    monkeypatch.setattr(langid, "BOUND", 5)
    assert (langid.bundle([text, "ab"], [0, 1], 2, 128)[0] == whole).all()
    assert (langid.bundle([text, "ab"], [0, 0], 1, 128)[0][0] == whole.sum(axis=0)).all()


def test_many_languages_in_passes(spark):
    rows = [(k, "abcdefghij"[k % 7 :] * 5, f"l{k % 7}") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = langid.profiles(docs)
    once, thrice = (ordered(map(tuple, langid.predict(docs, learned, most=n).collect())) for n in (256, 3))
    assert once == thrice
    assert {r[1] for r in once} == {f"l{k}" for k in range(7)}


def test_languages_of_odd_documents(spark, odd_documents, no_documents):
    found = langid.identify_languages(odd_documents).collect()
    assert len(found) == odd_documents.count() and {r.lang_pred for r in found} <= {"en", "und"}
    assert langid.identify_languages(no_documents).count() == 0
    unlabelled = odd_documents.withColumn("lang", F.lit(None).cast("string"))
    assert {(r.lang_pred, r.score) for r in langid.identify_languages(unlabelled).collect()} == {("und", 0.0)}


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    found = queries.op12_hyperdimensional_language(spark, sf).filter("held_out").join(docs, "doc_id")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98


# Divergence


def brute_divergence(rows, least=3, ranks=200):
    counts, groups, texts = Counter(), defaultdict(set), defaultdict(set)
    for k, (lang, source, text) in enumerate(rows):
        lang, source, low = lang or "", source or "", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        groups[lang].add(source)
        for term in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low):
            counts[lang, source, term] += 1
            texts[lang, term].add(k)
    out = []
    for lang, sources in groups.items():
        kept = [t for (of, t), held in texts.items() if of == lang and len(held) >= least]
        n = {s: sum(counts[lang, s, t] for t in kept) for s in sources}
        p = {(s, t): 1 + 10**9 * (counts[lang, s, t] + 1) // (n[s] + len(kept)) for s in sources for t in kept}
        q = {t: 1 + 10**9 * (sum(counts[lang, s, t] for s in sources) + 1) // (sum(n.values()) + len(kept)) for t in kept}
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(-sum(f(p[s, t], p[o, t]) for t in kept), o.encode(), o) for o in sources if o != s]
            terms = [(-f(p[s, t], q[t]), t.encode(), t) for t in kept if counts[lang, s, t] and p[s, t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, ranks)):
                out += [(lang, s, part, item, -value, k) for k, (value, _, item) in enumerate(sorted(found)[:most], 1)]
    return ordered(out)


def test_divergence_of_odd_documents(spark, odd_documents, no_documents):
    rows = [(r.lang, r.source, r.text) for r in odd_documents.select("lang", "source", "text").collect()]
    for least, ranks in ((3, 200), (1, 3), (99, 200)):
        found = divergence.source_divergence(odd_documents, least, ranks)
        assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
        assert ordered(map(tuple, found.collect())) == brute_divergence(rows, least, ranks)
    assert divergence.source_divergence(no_documents).count() == 0


def test_terms_in_pieces():
    text = "Über alles, geht's don't 漢字x ".encode() * 50
    whole = [t for part in divergence.term_pieces(text) for t in part]
    for piece in (1, 7, 64):
        assert [t for part in divergence.term_pieces(text, piece) for t in part] == whole
    assert whole[:5] == ["Über".encode(), b"alles", b"geht", b"s", b"don"]
