"""Operators against brute force."""

import collections
import functools
import hashlib
import math
import pathlib
import random
import re
import time
import urllib.parse
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import DATA, SMALL
from recordloom import storage
from recordloom.llm import common, decontam, licenses, linededup, lm, neardup, packing, pii, quality, toxicity, urls
from recordloom.llm.queries import tokenizer_path


def frame(spark, name, where=SMALL):
    return spark.read.parquet(f"{where}/{name}.parquet")


def texts(spark, where=SMALL):
    return [(r["doc_id"], r["text"] or "") for r in frame(spark, "documents", where).orderBy("doc_id").collect()]


def lowered(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


# ------------------------------------------------ licences

def test_base_places(spark):
    got = {r["doc_id"]: r for r in licenses.scan(frame(spark, "documents")).collect()}
    for doc, text in texts(spark):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
        at = [(k, label) for phrase, label in licenses.BASE.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
        r = got[doc]
        assert (r["n_words"], r["n_base"]) == (len(w), len(at))
        assert (r["first_word"], r["last_word"]) == (min(at)[0] if at else None, max(at)[0] if at else None)
        assert r["base_labels"] == ",".join(sorted({x for _, x in at}))
        assert 0 <= r["score"] <= 1


def test_licence_texts_and_their_parts(spark):
    rows, expected = [], []
    for label, templates in licenses.TEMPLATES.items():
        for text, _ in templates:
            rows.append(f"some words before, {text.upper()} -- and after")
            expected.append(label)
    rows += ["License MIT", "the mit, License here", "general public", "except in compliance with the law"]
    expected += ["", "mit", "", ""]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in licenses.scan(df).collect()}
    for k, label in enumerate(expected):
        assert (label in got[k].split(",")) if label else got[k] == "", (rows[k], got[k])


def test_labels_by_looking_everywhere(spark):
    rng = random.Random(4)
    texts_ = [t for ts in licenses.TEMPLATES.values() for t, _ in ts]
    rows = []
    for _ in range(300):
        w = " ".join(rng.choice(texts_) for _ in range(rng.randint(1, 3))).split()[rng.randint(0, 8) :] or ["a"]
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(["x", "license", "the", "mit"])
        rows.append(" ".join(w))
    rows.append("copy " * 3000 + "software permission to use copy modify")
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    for k, text in enumerate(rows):
        w = licenses.words_of(text)
        base = {label for phrase, label in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()}
        labels, share = set(base), 0.0
        for t in licenses._templates():
            counted = [j for j, x in enumerate(t.words) if x not in licenses._PLAIN]
            for start in range(-len(t.words), len(w)):
                if all(0 <= start + at and w[start + at : start + at + len(p)] == p for at, p in t.phrases):
                    agree = sum(0 <= start + j < len(w) and w[start + j] == t.words[j] for j in counted)
                    if agree >= min(licenses.MATCHES, len({t.words[j] for j in counted})):
                        labels.add(t.label)
                        share = max(share, agree / len(counted))
        assert got[k]["labels"] == ",".join(sorted(labels)), text
        assert got[k]["score"] == pytest.approx(1.0 if base else share)


# ------------------------------------------------ toxicity

def test_scores_are_those_of_whole_feature_vectors(spark):
    """By the definition: counts of hashed n-grams over the distinct words, times the weights."""
    rng = random.Random(2)
    vocabulary = ["".join(rng.choice("abcdef") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    rows = [(k, " ".join(rng.choice(vocabulary[:40] if k % 2 else vocabulary[20:]) for _ in range(30))) for k in range(80)]
    docs = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    own = toxicity.fit([(t, k % 2) for k, t in rows[:60] if zlib.crc32(str(k).encode()) % 3 != 1])
    assert np.allclose(np.sort(model.weights), np.sort(own.weights), atol=0.2)  # the rows' order and rates are the only difference
    got = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, labels).collect()}
    for k, text in [*rows, (900, None), (901, "")]:
        counts = collections.Counter(b for word in set((text or "").lower().split()) for b in set(toxicity.features([word])[1].tolist()))
        logit = model.bias + sum(n * float(model.weights[b]) for b, n in counts.items())
        assert got[k] == pytest.approx(1 / (1 + math.exp(-logit)), abs=1e-6)


def test_features_are_those_of_ngrams():
    """As many buckets as there are different n-grams of 3 to 5 characters, alike in any company."""
    words = ["", "a", "abab", "ünïcode", "x" * 40, "\U0001f600k", "ab"]
    number, bucket = toxicity.features(words)
    for k, w in enumerate(words):
        grams = {f"<{w}>"[i : i + n] for n in (3, 4, 5) for i in range(len(w) + 2 - n + 1)}
        own = bucket[number == k]
        assert len(own) == len(set(own.tolist())) == len(grams), w
        assert own.tolist() == toxicity.features([w])[1].tolist()
    assert len(toxicity.features([])[0]) == 0


def test_a_repeated_id_teaches_once(spark):
    docs = spark.createDataFrame([(1, "good words here")] * 50 + [(2, "bad words there")] * 3, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 0), (2, 1)], "doc_id long, toxic int")
    rows, rates = toxicity.labelled_sample(docs, labels, F.lit(True), "doc_id", "text", "toxic", 10)
    assert rows == [("good words here", 0), ("bad words there", 1)] and rates == (1 / 3, 2 / 3)


def test_held_out_toxicity(spark):
    docs, labels = frame(spark, "documents", DATA), frame(spark, "labels", DATA)
    got = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    hits = ((got["predicted"] == 1) & (got["toxic"] == 1)).sum()
    assert hits / max(1, (got["predicted"] == 1).sum()) >= 0.95
    assert hits / (got["toxic"] == 1).sum() >= 0.7
    assert got["score"].between(0, 1).all()


def test_held_labels_teach_nothing(spark):
    docs, labels = frame(spark, "documents"), frame(spark, "labels")
    turned = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, labels).collect()}
    b = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, turned).collect()}
    assert a == b


# ------------------------------------------------ quality

def test_rule_order_changes_nothing(spark):
    docs = frame(spark, "documents", DATA)
    a = quality.quality(docs, rules=quality.RULES).where("kept").select("doc_id")
    b = quality.quality(docs, rules=list(reversed(quality.RULES))).where("kept").select("doc_id")
    assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0
    assert {r.name for r in quality.rule_order(docs)} == {r.name for r in quality.RULES}


# ------------------------------------------------ near duplicates

def test_fingerprints_are_xxh64(spark):
    df = spark.createDataFrame([("The Quick brown FOX jumps",), ("one",)], "t string")
    for (text,) in [(r["t"],) for r in df.collect()]:
        w = text.lower().split()
        shingles = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))]
        hashes = [r["h"] & (1 << 64) - 1 for r in spark.createDataFrame([(s,) for s in shingles], "s string").select(F.xxhash64("s").alias("h")).collect()]
        bits = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert neardup.simhash(text.encode()) == bits
    assert neardup.simhash(b" \n") == 0


def classes(values, distance):
    label = np.arange(len(values))
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= distance
    while True:
        new = np.where(near, label[None, :], len(values)).min(1)
        if (new == label).all():
            return label
        label = new


@pytest.mark.parametrize(("cell", "block"), [(128, 1024), (4, 5), (1, 3)])
def test_links_of_clustered_fingerprints(spark, cell, block):
    rng = random.Random(5)
    values = set()
    for _ in range(40):
        centre = rng.getrandbits(64)
        for _ in range(rng.choice([1, 3, 30])):
            v = centre
            for _ in range(rng.randint(0, 5)):
                v ^= 1 << rng.randrange(64)
            values.add(v)
    values |= {0, (1 << 64) - 1, 1 << 63}
    found = np.array(sorted(values), np.uint64)
    fps = spark.createDataFrame([(int(v),) for v in found.view(np.int64)], "fp long")
    links = neardup.fingerprint_links(fps, 3, cell, block).collect()
    of = {int(v): k for k, v in enumerate(found.view(np.int64))}
    parent = list(range(len(found)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for r in links:
        assert bin((r["a"] ^ r["b"]) & (1 << 64) - 1).count("1") <= 3 or cell < 128
        a, b = sorted((root(of[r["a"]]), root(of[r["b"]])))
        parent[b] = a
    assert [root(k) for k in range(len(found))] == classes(found, 3).tolist()


def test_classes_of_documents(spark):
    docs = texts(spark)
    own = np.array([neardup.simhash(t.encode()) for _, t in docs], np.uint64)
    label = classes(own, 3)
    got = {r["doc_id"]: r for r in neardup.near_duplicates(frame(spark, "documents")).collect()}
    for k, (doc, _) in enumerate(docs):
        assert got[doc]["fingerprint"] == f"{int(own[k]):016x}"
        assert got[doc]["component_id"] == docs[label[k]][0]
    assert neardup.keep_one_per_class(frame(spark, "documents")).count() == len(set(label))


@pytest.mark.parametrize("crowded", [False, True])
def test_similar_texts_by_brute_force(spark, monkeypatch, crowded):
    """One text of each class of five-word shingle sets that are alike by 0.8, linked through others or not."""
    rng = random.Random(12)
    common = " ".join(f"shared{k}" for k in range(30))
    rows = ["", " ", "one two", "ONE two", "one two three"]
    for _ in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(8, 150))] + (common.split() if rng.random() < 0.5 else [])
        for _ in range(rng.choice([1, 2, 6])):
            copy = list(words)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = f"edit{rng.randrange(99)}"
            rows.append(" ".join(copy))
    if crowded:
        monkeypatch.setattr(neardup, "candidate_pairs", functools.partial(neardup.candidate_pairs, cell_rows=4))
        monkeypatch.setattr(neardup, "NEAREST", 1)
    sets = [set(neardup._shingles(t.encode(), 5)) for t in rows]
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = [new if x == old else x for x in label]
    got = neardup.keep_one_per_class(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), words=5, similarity=0.8)
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(set(label))


def test_similar_texts_of_a_crowd_all_meet(spark, monkeypatch):
    """Pairs of texts that are alike, all with a passage in common, which makes up most of their shingles."""
    monkeypatch.setattr(neardup, "CROWD_ROWS", 64)
    passage, rows = [f"common{k}" for k in range(100)], []
    for pair in range(160):
        own = [f"w{pair}x{k}" for k in range(16)]
        rows += [" ".join(passage + own), " ".join(passage + own[:7] + [f"other{pair}"] + own[8:])]
    sets = [set(neardup._shingles(t.encode(), 5)) for t in rows]
    assert all((len(p & q) >= 0.8 * len(p | q)) == (a // 2 == b // 2) for a, p in enumerate(sets) for b, q in enumerate(sets))
    got = neardup.keep_one_per_class(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), words=5, similarity=0.8)
    assert sorted(r["doc_id"] for r in got.collect()) == list(range(0, len(rows), 2))


def test_large_groups_are_compared_in_blocks(spark, monkeypatch):
    """Near copies of one text, some of which no path of similar texts joins to the others; no hash of theirs is rare."""
    monkeypatch.setattr(neardup, "candidate_pairs", functools.partial(neardup.candidate_pairs, cell_rows=8))
    monkeypatch.setattr(neardup, "CROWD", 10_000)
    monkeypatch.setattr(neardup, "CROWD_ROWS", 16)
    monkeypatch.setattr(neardup, "fingerprint_links", lambda fps, distance: fps.select(neardup.F.col("fp").alias("a"), neardup.F.col("fp").alias("b")).limit(0))
    draw = np.random.default_rng(3)
    base, rows = [f"b{k}" for k in range(120)], []
    for k in range(150):
        words = list(base)
        for at in draw.choice(120, draw.integers(0, 5), replace=False):
            words[at] = f"x{k}y{at}"
        rows.append(" ".join(words))
    rows = sorted(set(rows))
    sets = [set(neardup._shingles(t.encode(), 5)) for t in rows]
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and label[a] != label[b]:
                lo, hi = sorted((label[a], label[b]))
                label = [lo if x == hi else x for x in label]
    assert 1 < len(set(label)) < len(rows)
    got = neardup.keep_one_per_class(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), words=5, similarity=0.8)
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(set(label))


def test_similar_texts_hold_little_disk(spark):
    """Of the written tables only the classes are left (texts, prefixes and candidates are not), no shuffle of
    theirs is, and the documents go through one exchange to their classes."""
    folder = pathlib.Path(storage.shared_dir(spark).removeprefix("file://"), "recordloom")
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()

    def tables():
        return set(folder.iterdir()) if folder.exists() else set()

    def shuffled():
        return {f for f in files.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}

    rng = random.Random(4)
    rows = [" ".join(f"w{rng.randrange(900)}" for _ in range(400)) for _ in range(300)]
    rows += [t + " more" for t in rows[:100]]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)
    before, old = tables(), shuffled()
    got = neardup.keep_one_per_class(docs, words=5, similarity=0.8)
    left = {p.name.rsplit("-", 1)[0] for p in tables() - before}
    assert "heads" in left
    assert not left & {"sketch", "texts", "inprefix", "crowded", "candidates", "asked"}
    for _ in range(50):  # they are removed in the background
        kept = sum(pathlib.Path(f).stat().st_size for f in shuffled() - old if pathlib.Path(f).exists())
        if kept < 300_000:
            break
        time.sleep(0.2)
    assert kept < 300_000  # the texts alone are 800 kB
    assert sorted(r["doc_id"] for r in got.collect()) == list(range(300))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 0 and plan.count("Aggregate") <= 2


def test_rows_of_a_class_head_stay_whole(spark):
    """Null ids, repeated rows and other columns, nested ones too: one row of each head, with what it had."""
    schema = "doc_id long, text string, n int, tags map<string,int>"
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(None, text, 1, {"a": 1}), (2, text, 2, None), (2, text, 2, None), (3, None, None, None), (None, "x y", 5, {"b": 2}), (4, "", 9, {})]
    got = neardup.keep_one_per_class(spark.createDataFrame(rows, schema), words=5, similarity=0.8)
    assert got.columns == ["doc_id", "text", "n", "tags"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted([rows[1], rows[3], rows[4]], key=repr)


# ------------------------------------------------ language model

def test_scores_by_simulation(spark):
    docs = texts(spark)
    words, contexts = collections.Counter(), [collections.defaultdict(collections.Counter) for _ in range(lm.ORDER + 1)]
    for doc, text in docs:
        if zlib.crc32(str(doc).encode()) % 7 == 2:
            continue
        words.update(lowered(text).encode().split() + [" "])
        raw = bytes([lm.START]) * lm.ORDER + lowered(text).encode() + bytes([lm.END])
        for k in range(lm.ORDER, len(raw)):
            for order in range(lm.ORDER + 1):
                contexts[order][raw[k - order : k]][raw[k]] += 1
    total, kinds = sum(words.values()), len(words)

    def simulate(text):
        raw, score = bytes([lm.START]) * lm.ORDER + text.encode() + bytes([lm.END]), 0.0
        for k in range(lm.ORDER, len(raw)):
            excluded = set()
            for order in range(lm.ORDER, -1, -1):
                left = {s: n for s, n in contexts[order].get(raw[k - order : k], {}).items() if s not in excluded}
                if not left:
                    continue
                room = sum(left.values()) + len(left)
                if raw[k] in left:
                    score += math.log10(left[raw[k]] / room)
                    break
                score += math.log10(len(left) / room)
                excluded |= set(left)
            else:
                score -= math.log10(256 - len(excluded))
        return score

    got = {r["doc_id"]: r for r in lm.language_model_scores(frame(spark, "documents"), frequent=300).collect()}
    for doc, text in docs[:60]:
        tokens = lowered(text).encode().split() + [" "]
        r = got[doc]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens), sum(words[t] > 0 for t in tokens), total)
        assert r["held_out"] == (zlib.crc32(str(doc).encode()) % 7 == 2)
        assert r["base_score"] == pytest.approx(sum(math.log10((words[t] + 1) / (total + kinds + 1)) for t in tokens), abs=1e-6)
        assert r["score"] == pytest.approx(simulate(lowered(text)), abs=1e-6)


def test_probabilities_add_up():
    texts_ = [b"abracadabra", b"abba"]
    counts = [collections.Counter() for _ in range(lm.ORDER + 1)]
    for code in lm.grams(texts_)[0].tolist():
        for k in range(lm.ORDER + 1):
            counts[k][code & (1 << 8 * (k + 1)) - 1] += 1
    trie = lm.build_trie([np.array(list(c), np.int64) for c in counts], [np.array(list(c.values())) for c in counts])
    for context in (b"abra", b"zzra", b"zzzz"):
        codes = (int.from_bytes(context, "big") << 8) + np.arange(256)
        assert (10.0 ** lm.code_lengths(codes, trie)).sum() == pytest.approx(1)


def test_parts_of_a_batch():
    texts = ["a" * 400, None, "b" * 700, "", "c" * 5000, "d"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(texts)], ["k", "t"])
    cut = list(common.parts(batch, 1, 1000))
    assert [x for p in cut for x in p.column(0).to_pylist()] == list(range(6)) and len(cut) > 2
    assert all(len(p) == 1 or sum(len(t or "") for t in p.column(1).to_pylist()) <= 1000 for p in cut)
    assert len(list(common.parts(batch.slice(0, 0), 1))) == 1


def test_pruned_model_is_closed(spark):
    whole = lm.language_model_scores(frame(spark, "documents"), edges=3000).toPandas()
    assert (whole["score"] < 0).all() and np.isfinite(whole["score"]).all()


def test_bound_of_the_tasks_model_changes_no_score(spark):
    whole, few, none = (lm.language_model_scores(frame(spark, "documents"), edges=n).toPandas().set_index("doc_id").sort_index() for n in (lm.EDGES, 3000, 1))
    for other in (few, none):
        assert np.allclose(whole["score"], other["score"], atol=1e-6) and np.allclose(whole["base_score"], other["base_score"], atol=1e-6)


# ------------------------------------------------ decontamination

def test_suffix_array_order():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 4, 300)
    order = decontam.suffix_array(words, 13)
    keys = [tuple(np.concatenate([words[k : k + 16], np.zeros(16, int)])[:16]) for k in order]
    assert keys == sorted(keys)


@pytest.mark.parametrize("window", [1, 2, 5, 13])
def test_shard_against_scan(window):
    rng = random.Random(window)
    def make(n):
        return " ".join(rng.choice("abcde") for _ in range(n)).encode()

    docs, items = [make(n) for n in (0, 1, 5, 40, 200)], [(k, make(rng.choice([1, 3, 6, 20])).decode()) for k in range(6)]
    index = decontam.test_index(items, window)
    for found, doc in zip(decontam.scan_shard(docs, index), docs):
        w, hit, owners = doc.decode().split(), set(), set()
        for key, text in items:
            q = text.split()
            for at in range(max(1, len(q) - window + 1)):
                part = q[at : at + window]
                for k in range(len(w) - len(part) + 1):
                    if w[k : k + len(part)] == part:
                        hit |= set(range(k, k + len(part)))
                        owners.add(str(key))
        got = {k for b, e in zip(found.stretches[::2], found.stretches[1::2]) for k in range(b, e)}
        assert (found.n_words, got, found.items) == (len(w), hit, sorted(owners))
        best = None
        for key, text in items:
            q = text.split()
            for at in range(len(w)):
                for there in range(len(q)):
                    n = 0
                    while at + n < len(w) and there + n < len(q) and w[at + n] == q[there + n]:
                        n += 1
                    # Only matches of a window or more count: of as many words, or of the whole item.
                    begins = not (at and there and w[at - 1] == q[there - 1])
                    if n and n >= min(window, len(q)) and begins:
                        best = min(best or (-n, at, str(key), there), (-n, at, str(key), there))
        assert (best or (0, None, None, None)) == (-found.longest, found.place, found.item, found.item_place)


def test_several_passes_agree(spark, monkeypatch):
    docs, bench = frame(spark, "documents"), frame(spark, "benchmark")
    one = decontam.contamination(docs, bench)
    monkeypatch.setattr(decontam, "BENCHMARK_BYTES", 3000)
    many = decontam.contamination(docs, bench)
    assert one.exceptAll(many).count() == many.exceptAll(one).count() == 0


# ------------------------------------------------ personal data

CASES = [
    ("a.b@x.example.com", "email"), ("+1 (743) 555-3824", "phone"), ("743-555-3824", "phone"), ("84.251.36.42", "ip"), ("4111 1111 1111 1111", "card"),
    ("078-05-1120", "ssn"), ("DE89 3704 0044 0532 0130 00", "iban"), ("2bae4de4a39e2afeae70f70a1d01f55b0de0d80b", "secret"), ("Mary Parker", "name"), ("Иван Петров", "name"),
]


def test_kinds_formats_and_gender(spark):
    df = spark.createDataFrame([(k, f"see {v}, there") for k, (v, _) in enumerate(CASES)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.pseudonymize(df, "k").collect()}
    for k, (value, kind) in enumerate(CASES):
        assert got[k]["_entities"] == [kind], value
        new = got[k]["text"].removeprefix("see ").removesuffix(", there")
        assert new != value
        if kind not in ("ip", "name"):
            assert re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "0", new))) == re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "0", value))) or kind == "secret"
    assert all(0 <= int(x) < 256 for x in re.search(r"[\d.]+\d", got[3]["text"])[0].split("."))
    digits = [int(c) for c in re.sub(r"\D", "", got[4]["text"])]
    assert sum(sum(divmod(2 * d, 10)) if k % 2 else d for k, d in enumerate(reversed(digits))) % 10 == 0
    assert got[8]["text"].split()[1] in pii.FEMALE["latin"]
    assert got[9]["text"].split()[1] in pii.MALE["cyrillic"] and re.fullmatch(r"[А-Я][а-я]+", got[9]["text"].split()[2].rstrip(","))


def test_same_value_same_surrogate_and_no_two_alike(spark):
    values = [f"user{k}@mail.example.com" for k in range(400)] + [f"+1 (2{k:02d}) 555-01{k:02d}" for k in range(100)]
    rows = [(k, f"{v} and {v.upper() if '@' in v else v[3:]}") for k, v in enumerate(values)]
    got = [r["text"].split(" and ") for r in pii.pseudonymize(spark.createDataFrame(rows, "doc_id long, text string"), "k").orderBy("doc_id").collect()]
    assert len({a for a, _ in got}) == len(values)
    for a, b in got:
        assert a.lower().removeprefix("+1 ") == b.lower()
    other = [r["text"] for r in pii.pseudonymize(spark.createDataFrame(rows[:5], "doc_id long, text string"), "another").collect()]
    assert not {" and ".join(x) for x in got[:5]} & set(other)


def test_no_value_is_kept_whatever_its_script_and_length(spark):
    values = ["Password: ________", "Key:\n========", 'token: "++++++++"', "张伟@例子.com", "łść@żół.pl", "İẞ@ǅ.de", "שלום@ישראל.com", "김철수@한국.kr"]
    values += [f"Dr {a}{b}" for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for b in "abcdefghijklmnopqrstuvwxyz"]
    df = spark.createDataFrame(list(enumerate(values)), "doc_id long, text string")
    got = [r for r in pii.pseudonymize(df, "k").orderBy("doc_id").collect()]
    assert [r["text"] for r in got[:3]] == values[:3] and not any(r["_entities"] for r in got[:3])
    assert all(r["text"] != v and len(r["text"]) == len(v) for r, v in zip(got[3:], values[3:]))
    assert len({r["text"] for r in got}) == len(values)
    assert got[3]["text"].endswith(".com") and all("\u3400" <= c <= "\U0002ffff" for c in got[3]["text"][:2])


def test_surrogates_of_many_values(spark):
    """Against the whole table of values: distinct stay distinct, none stays, kinds and formats stay."""
    rng = random.Random(8)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card(valid):
        head = "4" + digits(14)
        total = sum(sum(divmod(2 * int(c), 10)) if k % 2 == 0 else int(c) for k, c in enumerate(reversed(head)))
        return head + str((-total + (0 if valid else rng.randint(1, 9))) % 10)

    names_ = [f"{g} {s}" for g in pii.FEMALE["latin"] + pii.MALE["latin"] for s in ("Parker", "Mary", "Ann")]
    values = [card(k % 2) for k in range(300)] + names_ + [f"Dr {a}{b}{c}" for a in "AJM" for b in "aou" for c in "abcdefghijklmnopqrstuvwxyz"]
    values += ["password: " + "".join(rng.choice("abcdef0123456789") for _ in range(rng.choice([32, 40]))) for _ in range(60)] + [f"key = {w}" for w in ("deadbeef", "feedface", "zzzzzzzz", "cafebabe", "abcdefgh")]
    values += ["AKIA" + "".join(rng.choice("ABCDEFGH0123") for _ in range(16)) for _ in range(30)] + [f"DE{digits(2)} {digits(4)} {digits(4)} {digits(4)} {digits(4)} {digits(2)}" for _ in range(30)]
    values = list(dict.fromkeys(values))
    rows = [(k, v) for k, v in enumerate(values)] + [(len(values) + k, f"again {v}") for k, v in enumerate(values)]
    got = {r["doc_id"]: r for r in pii.pseudonymize(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    new = [got[k]["text"] for k in range(len(values))]
    assert all(got[k]["_entities"] for k in range(len(values)))
    assert len(set(new)) == len(values) and not [v for v, n in zip(values, new) if v == n]
    assert all(got[len(values) + k]["text"] == f"again {n}" for k, n in enumerate(new))  # coreference
    for old, n in zip(values, new):
        assert re.sub(r"\d", "0", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", n))) == re.sub(r"\d", "0", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", old))) or ":" in old or "=" in old or old[:2] in ("AK", "DE") or old.split()[0] in names_[0].split()[:1] + pii.FEMALE["latin"] + pii.MALE["latin"]
        assert not old.startswith("AKIA") or n.startswith("AKIA")
        assert not old.startswith("DE") or n.startswith("DE")
        if old[0] == "4":
            luhn = [sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(x))) % 10 for x in (old, n)]
            assert (luhn[0] == 0) == (luhn[1] == 0)


@pytest.mark.parametrize("text", ["password: --------", "key = ==========", "Mr Šš called", "Dr Հայկ wrote to us"])
def test_nothing_in_a_text_ends_the_query(spark, text):
    df = spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")
    a, b = pii.pseudonymize(df, "k").orderBy("doc_id").collect()
    assert a["text"] == b["text"] and len(a["text"]) == len(text) and (a["text"] != text or not a["_entities"])


def test_plain_text_is_left(spark):
    for text in ("version 1.2.3, 555 apples", "The Mark of May 2024-05-06 at 10:30", "pages 12-34 and 3.14159", ""):
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        assert pii.pseudonymize(df, "k").first()["text"] == text


# ------------------------------------------------ packing

def test_ids_are_the_tokenizers():
    from tokenizers import Tokenizer

    tok, ours = Tokenizer.from_file(tokenizer_path()), packing.WordIds(tokenizer_path())
    odd = ["Hello\tWorld. x y, don't ５!., é́ a\ńb <|endoftext|> İI", "", " . , ", "A_b., c-d. E̱. \x01 z", "“Q.” said. »r«, S"]
    for text, raw in zip(odd, ours(odd)):
        assert np.frombuffer(raw, "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids, text


def test_ids_behind_any_character():
    ours = packing.WordIds(tokenizer_path())
    chars = [chr(c) for c in range(1, 0x3200) if not 0xD800 <= c < 0xE000] + [chr(c) for c in range(0x3200, 0x110000, 401) if not 0xD800 <= c < 0xE000]
    rng = random.Random(1)
    pool = list("abcZ .,;'-\n\t İıßΣςéñü中文हिأب́ǅﬁ½²٣_<|>\x01\x1c\xa0\x85 ſK")
    texts_ = [p.replace("@", c) for p in ("D@, b", "a@. b @\n") for c in chars] + ["".join(rng.choice(pool) for _ in range(rng.randint(1, 14))) for _ in range(60000)]
    for k in range(0, len(texts_), 20000):
        some = texts_[k : k + 20000]
        theirs = ours.tokenizer.encode_batch_fast(some, add_special_tokens=False)
        assert not [t for t, raw, x in zip(some, ours(some), theirs) if np.frombuffer(raw, "<u4").tolist() != x.ids]


def test_equal_rows_have_places_of_their_own(spark):
    df = spark.createDataFrame([(1, "the same row")] * 3000 + [(2, "another")], "doc_id long, text string")
    got = packing.pack_documents(df, tokenizer_path()).toPandas()
    assert len(got) == 3001 and len(got[["sequence_id", "offset"]].drop_duplicates()) == 3001
    for _, rows in got.sort_values("offset").groupby("sequence_id"):
        assert rows["offset"].tolist() == [0, *rows["length"].cumsum().tolist()[:-1]] and rows["length"].sum() <= 2048


def test_packing_is_a_round_trip(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    ids = {d: [*tok.encode(t, add_special_tokens=False).ids, 0] for d, t in texts(spark)}
    got = packing.pack_documents(frame(spark, "documents"), tokenizer_path()).toPandas()
    for doc, rows in got.sort_values("piece").groupby("doc_id"):
        at = 0
        assert len(rows) == -(-len(ids[doc]) // 2048)
        for r in rows.itertuples():
            part = ids[doc][at : at + 2048]
            assert (r.start, r.length, r.ids_crc32) == (at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
            at += len(part)
    for _, rows in got.sort_values("offset").groupby("sequence_id"):
        assert rows["offset"].tolist() == [0, *rows["length"].cumsum().tolist()[:-1]] and rows["length"].sum() <= 2048
    assert got["sequence_id"].nunique() <= 1.03 * -(-got["length"].sum() // 2048) + 1


@pytest.mark.parametrize("seed", range(4))
def test_plans_place_every_piece_once(seed):
    rng = random.Random(seed)
    counts = collections.Counter(min(2048, max(1, int(rng.lognormvariate(6, 1 + seed / 3)))) for _ in range(4000))
    placed, fill = collections.Counter(), collections.defaultdict(list)
    for length, lo, hi, seq, offset in packing.plan_sequences(counts):
        placed[length] += hi - lo
        for k in range(hi - lo):
            fill[seq + k].append((offset, length))
    assert placed == counts
    for rows in fill.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(fill) <= 1.02 * sum(k * n for k, n in counts.items()) / 2048 + 3


# ------------------------------------------------ URLs

def test_decisions_follow_links(spark):
    def link(url):
        return f'<head><link rel="canonical" href="{url}"></head>'

    rows = [
        (1, "http://x.net/a", link("http://y.net/b")), (2, "http://y.net/b", link("http://z.com/de/c")), (3, "https://www.x.net/a/#frag", None), (4, "http://q.net/1", link("http://p.com/de/2")),
        (5, "http://q.net/1?utm_source=m", link("http://r.org/")), (6, "http://alone.net/", "<meta http-equiv='refresh' content='0; url=/relative'>"), (7, "http://m.net/", "<meta http-equiv='refresh' content='0; url=http://p.com/de/9'>"),
    ]
    got = {r["page_id"]: r["verdict"] for r in urls.verdicts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "block"}
    given = spark.createDataFrame([("http://alone.net/", "http://p.com/de/9")], "source string, target string")
    got = {r["page_id"]: r["verdict"] for r in urls.verdicts(spark.createDataFrame(rows, "page_id long, url string, html string"), given).collect()}
    assert got[6] == "block"


def test_links_are_resolved_as_browsers_do(spark):
    pages = ["http://a.net/x/y?z#f", "https://b.com", "http://b.com/d/", "http://a.net/x"]
    links = ["/new", "../x", "//h.org/p", "q.html", "?a=1&amp;b=2", "./", "..", "http://c.com/de/", "a/../b/./c", "../../../z", "mailto:x@y", "#f", ""]
    df = spark.createDataFrame([(p, x) for p in pages for x in links], "p string, x string")
    for r in df.select("p", "x", urls.resolved(F.col("x"), F.col("p")).alias("t")).collect():
        assert r["t"] == (None if r["x"] in ("mailto:x@y", "#f", "") else urllib.parse.urljoin(r["p"], r["x"].replace("&amp;", "&"))), r


def test_decisions_by_walking_all_links(spark):
    rng = random.Random(6)
    hosts, paths = ["a.net", "b.net", "www.a.net", "x.org", "y.com", "sub.example.org"], ["/de/p", "/fr/q", "/en/1", "/es/", "/z", ""]
    every = [f"http://{h}{p}" for h in hosts for p in paths]
    rows = [(k, u, f'<link rel="canonical" href="{rng.choice([rng.choice(every), rng.choice(paths) or "/", "//" + rng.choice(hosts) + "/z"])}">' if rng.random() < 0.4 else "") for k, u in enumerate(every * 2)]
    moved = [(rng.choice(every), rng.choice(every)) for _ in range(12)]
    plain = lambda u: re.sub(r"^https?://(www\.)?", "", u).rstrip("/")

    def ruled(u):
        host, path = re.match(r"https?://([^/]*)(.*)", u).groups()
        fits = [r for r in urls.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        return max(fits, key=lambda r: len(r.host + r.path)).verdict if fits else None

    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    said = {}
    links = [(u, urllib.parse.urljoin(u, re.search('href="([^"]*)', h)[1])) for _, u, h in rows if h] + moved
    for a, b in links:
        parent[root(plain(a))] = root(plain(b))
    for u in [*every, *(b for _, b in links)]:
        said.setdefault(root(plain(u)), set()).add(ruled(u))
    got = urls.verdicts(spark.createDataFrame(rows, "page_id long, url string, html string"), spark.createDataFrame(moved, "source string, target string")).collect()
    for r in got:
        u = rows[r["page_id"]][1]
        votes = said[root(plain(u))]
        assert r["verdict"] == (ruled(u) or ("allow" if "allow" in votes else "block" if "block" in votes else "allow")), u


# ------------------------------------------------ line runs

def test_ranks_order_suffixes(spark):
    """Ranks to a depth are the order of the suffixes' first lines, ties alike; the end of a sequence comes first."""
    rng = random.Random(3)
    docs = [(d, "\n".join(rng.choice(["a", "b", "c d", f"only {d} {k}"]) for k in range(rng.randint(1, 30)))) for d in range(30)]
    every = linededup.lines(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text")
    told = every.collect()
    number = collections.Counter(r["h"] for r in told)
    at = {(r["id"], r["j"]): r["h"] for r in told if number[r["h"]] > 1}

    def suffix(d, j, depth):
        out = []
        while len(out) < depth and (d, j) in at:
            out.append(at[d, j])
            j += 1
        return tuple(out)

    for k, level in enumerate(linededup.suffix_ranks(every, 8)):
        rank = {(r["id"], r["j"]): r["rank"] for r in level.collect()}
        assert rank.keys() == at.keys()
        keys = sorted(rank, key=lambda x: (rank[x], x))
        assert [suffix(*x, 1 << k) for x in keys] == sorted(suffix(*x, 1 << k) for x in keys)
        assert len({(rank[x], suffix(*x, 1 << k)) for x in keys}) == len(set(rank.values())) == len({suffix(*x, 1 << k) for x in keys})


def test_runs_are_maximal(spark):
    rng = random.Random(9)
    passage = "\n".join(f"line {k} of a passage that is said twice" for k in range(70))
    docs = [(1, "first\n" + passage + "\nend"), (2, "second of them\n" + passage + "\nanother end"), (3, passage.split("\n")[5] + "\n" + "\n".join(passage.split("\n")[30:40])), (4, " ".join(rng.choice("xyz") for _ in range(40)))]
    got = {r["id"]: [(x["first"], x["last"]) for x in r["runs"]] for r in linededup.repeated_runs(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {2: [(1, 70)], 3: [(1, 10)]}


@pytest.mark.parametrize("kind", ["string", "long"])
def test_ids_of_any_type_and_texts_under_one_id(spark, kind):
    text = "\n".join(f"line {k} has these words and some more of them" for k in range(4))
    docs = [("1", text), ("1", "x\n" + text), ("2", text), ("2", text), (None, text)]
    df = spark.createDataFrame(docs, "doc_id string, text string").withColumn("doc_id", F.col("doc_id").cast(kind))
    left = sorted(len((r["text"] or "").split()) for r in linededup.dedup_lines(df).collect())
    assert left == [0, 0, 0, 1, len(text.split())]



def brute_lines(docs, least):
    def windows(seq):
        for a in range(len(seq)):
            n = 0
            for b in range(a, len(seq)):
                n += seq[b][2]
                if n >= least:
                    yield a, b

    split = [(d, [(k, x, len(x.split())) for k, x in enumerate(t.split("\n")) if x.split()], t.split("\n")) for d, t in docs]
    first = {}
    for d, seq, _ in split:
        for a, b in windows(seq):
            key = tuple(x[1] for x in seq[a : b + 1])
            first[key] = min(first.get(key, (d, seq[a][0])), (d, seq[a][0]))
    out = {}
    for d, seq, lines in split:
        gone = set()
        for a, b in windows(seq):
            if first[tuple(x[1] for x in seq[a : b + 1])] < (d, seq[a][0]):
                gone |= set(range(seq[a][0], seq[b][0] + 1))
        out[d] = [x for k, x in enumerate(lines) if k not in gone and x.split()]
    return out


@pytest.mark.parametrize("least", [1, 4, 7, 20])
def test_every_repeated_run_goes(spark, least):
    rng = random.Random(least)
    stock = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 4))) for _ in range(6)]
    docs = [(d, "\n".join(rng.choice(stock) for _ in range(rng.randint(0, 14)))) for d in range(25)]
    done = linededup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), min_words=least).collect()
    got = {r["doc_id"]: [x for x in r["text"].split("\n") if x.split()] for r in done}
    assert got == brute_lines(docs, least)


def test_items_digest(spark):
    got = decontam.contamination(frame(spark, "documents"), frame(spark, "benchmark")).where("n_items = 0").first()
    assert got["items_sha256"] == hashlib.sha256(b"").hexdigest()
