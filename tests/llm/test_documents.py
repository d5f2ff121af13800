"""Near-duplicates, benchmark containment, toxicity, language-model scores, the corpus pipeline."""

import random
import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from offerflow.llm import components, decontaminate, hyperminhash, ppm, toxicity
from offerflow.llm.common import shingles, words as byte_words

from .conftest import SF, ordered, pairs, shingle_set, words


# Near-duplicates


def brute_components(rows, percent):
    ids = sorted({i for i, _ in rows if i is not None})
    sets = [(i, shingle_set(t)) for i, t in rows]
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    distinct = {}
    for i, s in sets:
        if s:
            distinct.setdefault(s, []).append(i)
    group = {}  # class -> its smallest id
    keys = list(distinct)
    links = [[0] * 0 for _ in keys]
    up = list(range(len(keys)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(keys)):
        for b in range(a):
            shared = len(keys[a] & keys[b])
            if 100 * shared >= percent * (len(keys[a]) + len(keys[b]) - shared):
                up[find(a)] = find(b)
    least = {}
    for k, s in enumerate(keys):
        known = [i for i in distinct[s] if i is not None]
        if known:
            least[find(k)] = min([*known, least.get(find(k), 1 << 62)])
    at = {s: k for k, s in enumerate(keys)}
    out = []
    for i, s in sets:
        component = least.get(find(at[s])) if s else i
        out.append((i, len(s), component, i == component))
    del links, group, parent, root
    return out


@pytest.mark.parametrize("percent", [85, 80])
@pytest.mark.parametrize("name", ["documents", "odd_documents"])
def test_near_duplicates(name, percent, request):
    df = request.getfixturevalue(name)
    found = [tuple(r) for r in hyperminhash.near_duplicates(df, percent).collect()]
    assert ordered(found) == ordered(brute_components(pairs(df), percent))


def test_no_near_duplicates(no_documents):
    assert hyperminhash.near_duplicates(no_documents).count() == 0


def chain_rows(n=120, length=60, step=3):
    """Texts in a chain: neighbours are linked, the ends share little; and a hub of small changes of one text."""
    rng = random.Random(5)
    flow = [f"w{rng.randrange(10**6)}" for _ in range(length + n * step)]
    rows = [(k, " ".join(flow[k * step : k * step + length])) for k in range(n)]
    hub = [f"h{rng.randrange(10**6)}" for _ in range(80)]
    for k in range(n):
        edited = list(hub)
        edited[rng.randrange(80)] = f"e{k}"
        rows.append((1000 + k, " ".join(edited)))
    return rows + [(2000 + k, " ".join(hub)) for k in range(50)]


def test_chains_and_hubs_over_blocks(spark, monkeypatch):
    rows = chain_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    monkeypatch.setattr(hyperminhash, "BLOCK_WEIGHT", 1 << 14)  # a few texts in each block
    found = [tuple(r) for r in hyperminhash.near_duplicates(df).collect()]
    assert ordered(found) == ordered(brute_components(rows, 85))


@pytest.mark.parametrize("percent", [85, 80])
def test_large_clusters_are_split_without_loss(spark, monkeypatch, percent):
    """Texts that share three quarters of their words, some with near copies, in clusters of many blocks."""
    rng = random.Random(9)
    common = [f"b{k}" for k in range(60)]
    rows = []
    for k in range(250):
        own = [f"o{rng.randrange(10**6)}" for _ in range(rng.choice([5, 9, 12, 20]))]
        text = common + own
        rows.append((k, " ".join(text)))
        if k % 5 == 0:
            text[rng.randrange(len(text))] = f"x{k}"
            rows.append((1000 + k, " ".join(text)))
    monkeypatch.setattr(hyperminhash, "BLOCK_WEIGHT", 1 << 14)
    monkeypatch.setattr(hyperminhash, "COUNT_BITS", 8)  # many shingles count as one
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = [tuple(r) for r in hyperminhash.near_duplicates(df, percent).collect()]
    assert ordered(found) == ordered(brute_components(rows, percent))


@pytest.mark.parametrize("percent", [85, 80])
def test_no_link_is_lost_on_ten_thousand_documents(spark, percent):
    """Against an exact join on the rarest shingles of each set."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    sets, first = {}, {}
    for i, text in pairs(docs):
        s = shingles((text or "").encode())
        if len(s):
            sets.setdefault(s.tobytes(), s)
            first[s.tobytes()] = min(i, first.get(s.tobytes(), i))
    often = Counter(x for s in sets.values() for x in s.tolist())
    held, up, linked = {}, {k: k for k in sets}, 0

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for key, s in sets.items():
        rarest = sorted(s.tolist(), key=lambda x: (often[x], x))[: len(s) + 1 - -(-len(s) * percent // 100)]
        for other in {o for x in rarest for o in held.get(x, ())}:
            shared = len(np.intersect1d(s, sets[other], assume_unique=True))
            if 100 * shared >= percent * (len(s) + len(sets[other]) - shared):
                linked += 1
                up[find(key)] = find(other)
        for x in rarest:
            held.setdefault(x, []).append(key)
    least = {}
    for key in sets:
        least[find(key)] = min(first[key], least.get(find(key), first[key]))
    expected = {(first[key], least[find(key)]) for key in sets}
    found = {(r.doc_id, r.component_id) for r in hyperminhash.near_duplicates(docs, percent).collect()}
    assert linked > 10 and expected <= found


def test_shingles_count_as_sets_do(documents):
    for _, text in pairs(documents):
        assert len(shingles((text or "").encode())) == len(shingle_set(text))
        assert [w.decode() for w in byte_words((text or "").encode())] == words(text)


def test_estimates_are_near_the_truth():
    rng = np.random.default_rng(2)
    for size, overlap in ((200, 0.9), (3000, 0.7), (40_000, 0.85)):
        guesses = []
        for _ in range(20):
            shared = int(2 * size * overlap / (1 + overlap))
            pool = np.unique(rng.integers(0, 1 << 63, 3 * size, np.uint64) * np.uint64(2))
            rng.shuffle(pool)
            a, b = np.sort(pool[:size]), np.sort(np.concatenate([pool[:shared], pool[size : 2 * size - shared]]))
            guesses.append(hyperminhash.estimate((hyperminhash.registers(a) == hyperminhash.registers(b)).mean(), size))
        assert abs(np.mean(guesses) - overlap) < 0.04


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(500 + k, 501 + k) for k in range(60)] + [(700, 700)]
    found = dict(components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect())
    parent = {x: x for e in edges for x in e}
    for _ in parent:
        for u, v in edges:
            parent[u] = parent[v] = min(parent[u], parent[v])
    expected = {x: p for x, p in parent.items() if any(x in e and e[0] != e[1] for e in edges)}
    assert set(found) == set(expected)
    assert len(set(found.values())) == len(set(expected.values())) == len({(found[x], expected[x]) for x in found})


def test_components_of_sorted_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(1000)] + [(5000, 5001 + k) for k in range(1000)] + [(None, 3), (4, None)]
    found = dict(components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert len(found) == 2002 and len({found[k] for k in range(1001)}) == len({found[5000 + k] for k in range(1001)}) == 1
    assert components.connected_components(spark.createDataFrame([(7, 7)], "u long, v long")).count() == 0


def test_incomplete_components_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(components, "MOST_ROUNDS", 1)
    with pytest.raises(RuntimeError):
        components.connected_components(spark.createDataFrame([(k, k + 1) for k in range(50)], "u long, v long"))


# Benchmark containment


def brute_contained(docs, items, percent=80):
    sets = [(k, shingle_set(t)) for k, t in items if k is not None and shingle_set(t)]
    out = []
    for i, t in docs:
        s = shingle_set(t)
        out += [(i, k, len(s & x), len(x)) for k, x in sets if 100 * len(s & x) >= percent * len(x)]
    return ordered(out)


@pytest.mark.parametrize("block", [1 << 20, 100])
def test_contained_items(spark, documents, block):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    found = [tuple(r) for r in decontaminate.contained_items(documents, items, block).collect()]
    expected = brute_contained(pairs(documents), [(r.item_id, r.text) for r in items.collect()])
    assert ordered(found) == expected and expected


def test_items_at_the_threshold(spark, odd_documents):
    long = [f"w{i % 977}" for i in range(60_000)]
    item = long[100:124]  # 20 shingles
    near, far = list(item), list(item)
    near[-4:] = ["a", "b", "c", "d"]  # 16 of 20 remain
    far[-5:] = ["a", "b", "c", "d", "e"]  # 15
    rows = [(1, " ".join(near)), (2, " ".join(far)), (3, " ".join(item).upper()), (4, "two words"), (5, ""), (6, None), (None, "two words"), (4, "two words")]
    items = spark.createDataFrame([(*r, 1) for r in rows], "item_id long, text string, doc_id int")
    found = [tuple(r) for r in decontaminate.contained_items(odd_documents, items).collect()]
    assert ordered(found) == brute_contained(pairs(odd_documents), rows)
    assert {r[1] for r in found if r[0] == 17} == {1, 3}


def test_containment_of_empty_tables(spark, documents, no_documents):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "two words")], "item_id long, text string")
    assert decontaminate.contained_items(documents, none).count() == 0
    assert decontaminate.contained_items(no_documents, some).count() == 0
    assert decontaminate.flag_contaminated(documents, none).filter("contaminated").count() == 0


@pytest.mark.parametrize("block", [1 << 20, 8])
def test_flags_are_those_of_the_search(spark, odd_documents, block):
    items = spark.createDataFrame([(1, "two words"), (2, "the quick brown fox jumps over the lazy dog"), (3, "nowhere to be found in these texts"), (4, "word")], "item_id long, text string")
    hit = {(r.doc_id) for r in decontaminate.contained_items(odd_documents, items, block).collect()}
    flagged = decontaminate.flag_contaminated(odd_documents, items, block_shingles=block)
    assert flagged.columns == [*odd_documents.columns, "contaminated"] and flagged.count() == odd_documents.count()
    assert {r.doc_id for r in flagged.filter("contaminated").collect()} == hit and hit


def test_search_looks_at_few_items():
    """What a document is compared with does not grow with the benchmark."""
    rng = np.random.default_rng(3)
    items = [(k, np.unique(rng.integers(0, 1 << 63, 30, np.uint64))) for k in range(5000)]
    block = decontaminate.ItemBlock(items)
    document = np.unique(np.concatenate([rng.integers(0, 1 << 63, 2000, np.uint64), items[7][1][6:], items[8][1][7:], items[9][1]]))
    assert set(block.candidates(document)) <= {7, 8, 9}
    assert [m[0] for m in block.matches(document)] == [7, 9]


# Toxicity


def auc(scores, truth):
    order = np.argsort(scores, kind="stable")
    rank = np.empty(len(order))
    rank[order] = np.arange(1, len(order) + 1)
    positive = truth.sum()
    return (rank[truth == 1].sum() - positive * (positive + 1) / 2) / (positive * (len(truth) - positive))


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.toxicity(docs, labels).join(labels.select("doc_id", "toxic"), "doc_id").filter("held_out and toxic is not null").toPandas()
    assert auc(rows["score"].to_numpy(), rows["toxic"].to_numpy()) > 0.9
    positive = rows[rows.predicted == 1]
    assert (positive.toxic == 1).mean() > 0.8 and positive.toxic.sum() / rows.toxic.sum() > 0.7


def test_pairs_mean_what_single_terms_do_not():
    """Neither term is toxic alone, nor the other pairs; the two together are."""
    rng = random.Random(1)
    texts, labels = [], []
    for _ in range(1600):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        texts.append(" ".join([*(f"common{rng.randrange(30)}" for _ in range(6)), *["vermin"] * insult, *["outsiders"] * group]))
        labels.append(int(insult and group))
    lists = [toxicity.terms(t.encode()) for t in texts]
    model = toxicity.fit(lists, np.array(labels, float))
    p = model.scores([toxicity.terms(t) for t in (b"vermin in the garden", b"outsiders in the garden", b"vermin and outsiders")])
    assert p[2] > 0.5 > max(p[0], p[1])
    assert np.array_equal(p, toxicity.fit(lists, np.array(labels, float)).scores([toxicity.terms(t) for t in (b"vermin in the garden", b"outsiders in the garden", b"vermin and outsiders")]))


@pytest.mark.parametrize("pair", [("rat", "foe"), ("vermin", "outsiders")])
def test_pairs_of_terms_that_are_neutral_alone(pair):
    """Toxic are texts with both or none: either term comes in as many toxic texts as others."""
    def make(n, seed):
        rng, lists, labels = random.Random(seed), [], []
        for _ in range(n):
            has = [rng.random() < 0.5 for _ in pair]
            lists.append(toxicity.terms(" ".join([*(f"common{rng.randrange(30)}" for _ in range(6)), *(w for w, x in zip(pair, has) if x)]).encode()))
            labels.append(float(has[0] == has[1]))
        return lists, np.array(labels)

    lists, labels = make(400, 2)
    assert ((toxicity.fit(*make(1600, 1)).scores(lists) > 0.5) == labels).mean() > 0.95


def rare_pair(n, together, probes=200):
    """Texts of which a tenth holds each of two terms that are neutral alone; with both they are toxic, as otherwise one in twelve is."""
    rng = np.random.default_rng(1)
    say = lambda *more: toxicity.terms(" ".join([*(f"common{k}" for k in rng.integers(0, 500, 40)), *more]).encode())
    lists, labels = [], []
    for k in range(n):
        u = rng.random()
        lists.append(say("outsiders", "vermin") if k < together else say("outsiders") if u < 0.1 else say("vermin") if u < 0.2 else say())
        labels.append(float(k < together or rng.random() < 0.08))
    return toxicity.fit(lists, np.array(labels)), {words: [say(*words) for _ in range(probes)] for words in ((), ("outsiders",), ("vermin",), ("outsiders", "vermin"))}


@pytest.mark.parametrize(("n", "together"), [(4000, 30), (16_000, 30)])
def test_rare_pairs_of_neutral_terms(n, together):
    model, probes = rare_pair(n, together)
    means = {words: model.scores(lists).mean() for words, lists in probes.items()}
    assert means["outsiders", "vermin"] > 0.5 and max(v for k, v in means.items() if len(k) < 2) < 0.2


def test_no_pair_begins_where_none_tells(spark):
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(1, 200, 20)) for _ in range(3000)]
    labels = (rng.random(3000) < 0.1).astype(float)
    texts, toxic = (np.bincount(np.concatenate(rows), w, 200) for w in (None, np.repeat(labels, [len(x) for x in rows])))
    assert toxicity.telling_pairs(rows, labels, texts, toxic, labels.mean()) == []
    assert toxicity.telling_pairs([], labels[:0], texts * 0, toxic * 0, 0.1) == []


def test_scores_are_sums_over_pairs(spark, documents):
    """Against the definition: the bias, the weights, and the product of the factors of each two terms."""
    model = toxicity.train(documents, spark.read.parquet(f"{SF}/labels.parquet"))
    for _, text in pairs(documents)[:60]:
        known = [k for k in model.slot[toxicity.terms((text or "").encode())].tolist() if k > 0]
        z = model.bias + sum(model.w[k] for k in known)
        z += sum(float(model.v[i] @ model.v[j]) for a, i in enumerate(known) for j in known[:a])
        assert model.scores([toxicity.terms((text or "").encode())])[0] == pytest.approx(1 / (1 + np.exp(-np.clip(z, -30, 30))), abs=1e-9)


def test_training_takes_all_terms_of_long_texts(spark, monkeypatch):
    """The toxic word's hash is above that of nearly all others, of which each text has thousands."""
    last = max((f"z{k}" for k in range(1000)), key=lambda w: toxicity.terms(w.encode())[0])
    rng = random.Random(8)
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 4 != 2]
    docs = spark.createDataFrame([(i, " ".join([f"{rng.randrange(10**9):09d}" for _ in range(3000)] + [last] * (i % 2))) for i in ids], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    slot = model.slot[toxicity.terms(last.encode())[0]]
    assert slot > 0 and model.w[slot] > 0
    monkeypatch.setattr(toxicity, "TRAIN_BYTES", 100_000)  # room for two or three whole texts
    monkeypatch.setattr(toxicity, "fit", lambda lists, labels: [x.tolist() for x in lists])
    fitted = toxicity.train(docs, labels)
    whole = {tuple(toxicity.terms(r.text.encode()).tolist()) for r in docs.collect()}
    assert 0 < sum(4 * len(x) for x in fitted) <= 100_000 and all(tuple(x) in whole for x in fitted)


def test_labels_of_the_held_out_fold_do_not_matter(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted(map(tuple, toxicity.toxicity(documents, x).collect())) for x in (labels, turned))
    assert a == b
    assert all(0 <= r[2] <= 1 and r[3] == int(r[2] >= 0.3) and r[1] == (zlib.crc32(str(r[0]).encode()) % 4 == 2) for r in a)


def test_toxicity_of_odd_documents(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([(1, 1, 1, "x"), (1, 0, 0, "x"), (4, 0, 0, "x"), (None, 1, 1, "x"), (9, 0, None, "x")], "doc_id long, quality int, toxic int, text string")
    rows = toxicity.toxicity(odd_documents, labels).collect()
    assert len(rows) == odd_documents.count() and all(r.score is not None for r in rows)
    assert toxicity.toxicity(no_documents, labels).count() == 0
    none = toxicity.toxicity(odd_documents, labels.limit(0)).collect()
    assert len(none) == len(rows) and len({round(r.score, 9) for r in none}) == 1


# Language-model scores


def brute_base(rows):
    train = [words(t) for i, t in rows if zlib.crc32((str(i) if i is not None else "").encode()) % 7 != 2]
    c = Counter(w for t in train for w in t)
    c[None] = len(train)
    c += Counter()
    total, kinds = sum(c.values()), len(c)
    out = []
    for i, t in rows:
        tokens = [*words(t), None]
        base = sum(log10((c.get(w, 0) + 1) / (total + kinds + 1)) for w in tokens)
        out.append((i, zlib.crc32((str(i) if i is not None else "").encode()) % 7 == 2, len(tokens), sum(c.get(w, 0) > 0 for w in tokens), total, base))
    return out


@pytest.mark.parametrize("name", ["documents", "odd_documents"])
def test_base_scores(name, request, monkeypatch):
    monkeypatch.setattr(ppm, "FREQUENT", 500)  # words on both sides of the bound
    df = request.getfixturevalue(name)
    found = ordered((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in ppm.lm_scores(df).collect())
    expected = ordered(brute_base(pairs(df)))
    assert [r[:5] for r in found] == [r[:5] for r in expected]
    assert np.allclose(sorted(r[5] for r in found), sorted(r[5] for r in expected), rtol=1e-9)


def brute_ppm(train, text, order, symbols=257):
    """Escape method C with exclusion, over dictionaries."""
    seen = {}
    for t in train:
        s = [*t, 256]
        for k in range(len(s)):
            for o in range(min(order, k) + 1):
                seen.setdefault(tuple(s[k - o : k]), Counter())[s[k]] += 1
    total, s = 0.0, [*text, 256]
    for k in range(len(s)):
        p, above = 1.0, set()
        deepest = next((o for o in range(min(order, k), -1, -1) if tuple(s[k - o : k]) in seen), -1)
        for o in range(deepest, -2, -1):
            if o < 0:
                # What no context has seen: equally likely among the symbols that are left.
                left = symbols - len(seen.get((), {}))
                p *= 1 / left
                break
            counts = seen[tuple(s[k - o : k])]
            left = {x: n for x, n in counts.items() if x not in above}
            n, kinds = sum(left.values()), len(left)
            if s[k] in left:
                p *= left[s[k]] / (n + kinds)
                break
            p *= kinds / (n + kinds) if n else 1.0
            above = set(counts)
        total += log10(p)
    return total


def test_scores_are_those_of_the_trie(spark):
    rng = random.Random(4)
    make = lambda: " ".join(rng.choice(["ab", "abba", "cab", "bad", "dab"]) for _ in range(rng.randrange(0, 30)))
    rows = [(i, make()) for i in range(60)] + [(100, "zzz ab é"), (101, ""), (102, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.score for r in ppm.lm_scores(df, order=3).collect()}
    train = [(t or "").encode() for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    for i, t in rows:
        assert found[i] == pytest.approx(brute_ppm(train, (t or "").encode(), 3), rel=1e-4, abs=1e-4)


@pytest.mark.parametrize("most_grams", [0, 40])
def test_scores_do_not_depend_on_what_is_broadcast(spark, most_grams):
    """Rare contexts count as they do in the whole trie."""
    rng = random.Random(6)
    make = lambda: " ".join(rng.choice(["ab", "abba", "cab", "bad", "dab"]) for _ in range(rng.randrange(0, 30)))
    rows = [(i, make()) for i in range(60)] + [(100, "zzz ab é"), (101, ""), (102, None)] + [(i, w) for i in range(200, 230) for w in ("baab zab", "q")]
    found = [(r.doc_id, r.score) for r in ppm.lm_scores(spark.createDataFrame(rows, "doc_id long, text string"), order=3, most_grams=most_grams).collect()]
    train = [(t or "").encode() for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    expected = sorted((i, brute_ppm(train, (t or "").encode(), 3)) for i, t in rows)
    assert [i for i, _ in sorted(found)] == [i for i, _ in expected]
    assert np.allclose([x for _, x in sorted(found)], [x for _, x in expected], rtol=1e-4, atol=1e-4)


def test_symbols_of_a_context_are_a_distribution(spark):
    """All symbols after one context, known and unknown ones, have probabilities that sum to 1."""
    train = [(k, t) for k, t in enumerate(["abracadabra", "abba", "cadabra ab", "brab", ""]) if zlib.crc32(str(k).encode()) % 7 != 2]
    held = next(i for i in range(100, 200) if zlib.crc32(str(i).encode()) % 7 == 2)
    for context in ("a", "ab", "abr", "xa", "q"):
        texts = [context.encode() + bytes([c]) for c in range(128)]
        rows = train + [(held, t.decode()) for t in texts] + [(held, context)]
        counted = ppm.count_corpus(spark.createDataFrame(rows, "doc_id long, text string"), 3)
        found = counted.filter("kind = 0").select("key", "n")
        cost = dict(ppm.gram_costs(found, ppm.trie(found, 3), 3).select("key", "cost").collect())
        keys = {int(ppm.grams([t], 3)[len(context)]) for t in texts} | {int(ppm.grams([context.encode()], 3)[-1])}
        seen = {b for _, t in train for b in t.encode()}
        left = 256 - len(seen | set(range(128)))  # bytes of other alphabets, each as likely as an unseen one here
        unseen = next(cost[int(ppm.grams([t], 3)[len(context)])] for t in texts if t[-1] not in seen)
        assert sum(10.0 ** cost[k] for k in keys) + left * 10.0**unseen == pytest.approx(1, abs=1e-5)


def test_contexts_beat_single_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    held = ppm.lm_scores(docs).filter("held_out").agg(F.sum("score").alias("score"), F.sum("base_score").alias("base")).first()
    assert held.score > held.base


def test_no_scores(no_documents):
    assert ppm.lm_scores(no_documents).count() == 0


# The pipeline


def test_stages_of_the_pipeline(spark):
    docs, labels, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_dedup", "decontamination", "packing"]
    scores = {r.doc_id: r.predicted for r in toxicity.toxicity(docs, labels).collect()}
    clean = stages["toxicity"](spark, docs, SF)
    assert clean.columns == docs.columns and sorted(i for i, _ in pairs(clean)) == sorted(i for i, p in scores.items() if not p)
    unique = stages["near_dedup"](spark, clean, SF)
    assert unique.columns == docs.columns and sorted(i for i, _ in pairs(unique)) == sorted(i for i, _, _, kept in brute_components(pairs(clean), 80) if kept)
    leaks = {i for i, *_ in brute_contained(pairs(unique), [(r.item_id, r.text) for r in items.collect()])}
    left = stages["decontamination"](spark, unique, SF)
    assert left.columns == docs.columns and {i for i, _ in pairs(left)} == {i for i, _ in pairs(unique)} - leaks
    packed = stages["packing"](spark, left, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {i for i, _ in pairs(left)}
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).select("doc_id", "start", "length", "ids_crc32").collect())) == sorted(map(tuple, packed.select("doc_id", "start", "length", "ids_crc32").collect()))


def test_stages_keep_odd_documents(spark, odd_documents, no_documents):
    for df in (odd_documents, no_documents):
        docs = df
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == df.columns, name
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
