"""Operators 11 to 13 against brute force, at parameters small enough that every path is taken, and on odd tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quarry.llm import merkle, phrases, simhash

DDL = "doc_id long, text string, lang string, source string, n_chars long, Part string, first string, tree string"


def docs_of(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, [None, "en", "fr", "und"][k % 4], f"s{k % 2}" if k % 5 else None, len(t) if t else None, "x", "y", "z") for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(rows, DDL)


def lower(text):
    return re.sub("[A-Z]+", lambda m: m.group().lower(), text or "")


# Operator 11


def mined(rows, least, top=2000):
    """The operator's result by plain counting."""
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    counts[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        found = []
        for p, a in f.items():
            if len(p) < 2 or a < least:
                continue
            if len(p) == 2 and any(2 * n >= a for q, n in f.items() if len(q) == 3 and n >= least and p in (q[:2], q[1:])):
                continue
            score, _, x, y = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), a, x, y))
        for rank, (score, _, p, a, x, y) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), a, x, y, totals[lang], -score))
    return sorted(out)


def phrase_texts(seed, n=160):
    gen = random.Random(seed)
    words = [w + "é" * (k % 3 == 0) for k, w in enumerate("alpha Beta gamma d e zeta Eta theta iota kappa".split())]
    out = [None, "", " . ,", "one", "Hot line of the day. Hot line of the day!\tHot line", "x\x0by\x0cz", "a" * 300]
    while len(out) < n:
        out.append("".join(gen.choices(words, [40, 20, 10, 5, 5, 4, 3, 2, 1, 1])[0] + gen.choice([" "] * 6 + ["\t ", ", ", ". ", "\n"]) for _ in range(gen.randrange(1, 60))) + (" the same closing words" if gen.random() < 0.3 else ""))
    return out


@pytest.mark.parametrize(("budget", "scan"), [(1 << 20, 1 << 20), (40, 90)])
def test_phrases(spark, budget, scan):
    texts = phrase_texts(budget)
    docs = docs_of(spark, texts).repartition(3)
    got = phrases.collocations(docs, least=4, budget=budget, scan=scan).collect()
    want = mined([(["und", "en", "fr", "und"][k % 4], t) for k, t in enumerate(texts)], 4)
    assert sorted(tuple(r) for r in got) == want and len(want) > 50


def test_phrase_prefixes_are_extended_where_they_exceed_the_budget(spark):
    texts = docs_of(spark, phrase_texts(5)).select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    made = phrases.partition(texts, 40, 1 << 20)
    assert len(made.extended) and len(made.long) and made.ends[0] < made.ends[1] < made.ends[2]
    assert {made.prefix_length(g) for g in range(made.ends[2])} == {1, 2, 3}


def test_top_phrases_and_ties(spark):
    texts = [f"left{k} right{k}. " * 5 for k in range(30)]
    docs = docs_of(spark, texts).withColumn("lang", F.lit("en"))
    got = phrases.collocations(docs, least=5, top=7).orderBy("rank").collect()
    assert [r["phrase"] for r in got] == sorted(f"left{k} right{k}" for k in range(30))[:7]
    assert {(r["score"], r["a"], r["n"]) for r in got} == {(1000000, 5, 300)}


def test_scores_pass_64_bits(spark):
    big = 3_000_000_000
    a = F.expr(f"CAST(1000000 AS DECIMAL(7,0)) * CAST({big}L AS DECIMAL(15,0)) * CAST({big}L AS DECIMAL(15,0)) div (CAST({big + 7}L AS DECIMAL(18,0)) * CAST({big + 9}L AS DECIMAL(18,0)))")
    assert spark.range(1).select(a).first()[0] == 1000000 * big * big // ((big + 7) * (big + 9))


def test_long_texts_are_cut_between_words(spark):
    text = ("One two three, four five " * 400 + "x" * 500 + " one two three") * 3
    whole = Counter()
    for chunk, own in phrases._chunks(text.encode(), 200):
        s = phrases.Suffixes([(chunk, own)], "en")
        words = [None, *s.words.to_pylist()]
        for a, b, c, n in zip(s.a, s.b, s.c, s.count, strict=True):
            whole[tuple(words[x] for x in (a, b, c) if x)] += n
    s = phrases.Suffixes([(text.encode(), len(text))], "en")
    words = [None, *s.words.to_pylist()]
    assert whole == Counter({tuple(words[x] for x in (a, b, c) if x): n for a, b, c, n in zip(s.a, s.b, s.c, s.count.tolist(), strict=True)})


# Operator 12


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text). The tree built whole, in lists."""
    def leaf(*xs):
        return digest("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in xs))

    def way_up(nodes):
        ways, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for k, i in enumerate(at):
                run = i - i % 8
                ways[k].append(("".join(nodes[run:i]), "".join(nodes[i + 1 : run + 8])))
                at[k] = i // 8
            nodes = [digest("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]
        return nodes[0], ways

    trees = defaultdict(list)
    for doc_id, source, lang, n, text in rows:
        bad = None if text is None else lower(text)
        tampered = leaf(doc_id, source, lang, n, bad) if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0 else None
        trees["" if lang is None else "=" + lang].append((-1 if doc_id is None else doc_id, leaf(doc_id, source, lang, n, text), tampered, doc_id))
    names = sorted(trees, key=str.encode)
    tops = {}
    for name in names:
        trees[name].sort(key=lambda r: r[:2])
        tops[name] = way_up([r[1] for r in trees[name]])
    root, above = way_up([tops[n][0] for n in names])
    out = []
    for k, name in enumerate(names):
        for row, way in zip(trees[name], tops[name][1], strict=True):
            way, node = way + above[k], row[2] or row[1]
            for a, b in way:
                node = digest(a + node + b)
            out.append((row[3], row[1], tops[name][0], root, digest("".join(a + b for a, b in way)), node, node == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("n", [1, 9, 1100])
def test_manifest(spark, n):
    gen = random.Random(n)
    texts = [gen.choice([None, "", "Text é", "TEXT", "plain", f"Row {k}"]) for k in range(n)]
    ids = [gen.choice([k, k, k, 7, None]) for k in range(n)]
    docs = docs_of(spark, texts, ids).withColumn("lang", F.when(F.col("doc_id") % 3 < 2, "en").otherwise(F.col("lang"))).repartition(5)
    rows = [(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]) for r in docs.collect()]
    got = sorted((tuple(r) for r in merkle.manifest(docs).collect()), key=str)
    assert got == plain_manifest(rows)


def test_manifest_of_many_languages(spark):
    docs = docs_of(spark, [f"T{k}" for k in range(600)]).withColumn("lang", F.concat(F.lit("l"), F.col("doc_id").cast("string")))
    rows = [(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]) for r in docs.collect()]
    assert sorted((tuple(r) for r in merkle.manifest(docs).collect()), key=str) == plain_manifest(rows)


def test_proofs_of_changed_texts_fail_and_others_hold(spark):
    rows = merkle.manifest(docs_of(spark, ["Upper", "lower"] * 50)).collect()
    for r in rows:
        assert r["verified"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 != 0 or r["doc_id"] % 2 == 1)


# Operator 13


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def linked(prints, radius=2):
    """Component (least id) of each of prints(id, fingerprint)."""
    at = {i: i for i, _ in prints}

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    values = np.array([p for _, p in prints], np.uint64)
    for k, (i, p) in enumerate(prints):
        for j in np.flatnonzero(np.bitwise_count(values[:k] ^ np.uint64(p)) <= radius).tolist():
            a, b = find(i), find(prints[j][0])
            at[max(a, b)] = min(a, b)
    return {i: find(i) for i in at}


def near_texts(seed, n=250):
    gen = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    out = [None, "", "\t\n", "one", "One two", "one two", "a b c", "é É x"]
    while len(out) < n:
        roll, real = gen.random(), [t for t in out if t and len(t) > 300]
        if real and roll < 0.6:
            w = gen.choice(real[:5]).split()
            for _ in range(gen.randrange(0, 3)):
                w[gen.randrange(len(w))] = gen.choice(words)
            out.append(gen.choice([" ", "\n"]).join(w).upper() if roll < 0.1 else " ".join(w))
        else:
            out.append(" ".join(gen.choice(words) for _ in range(gen.choice([1, 2, 3, 50, 200, 900]))))
    return out


@pytest.mark.parametrize("meeting", [8192, 20])
def test_simhash(spark, meeting):
    texts = near_texts(meeting)
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs_of(spark, texts).repartition(3), meeting=meeting).collect()}
    prints = [(i, plain_print(t)) for i, t in enumerate(texts)]
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: f"{p:016x}" for i, p in prints}
    assert {i: r["component_id"] for i, r in got.items()} == linked(prints)
    assert max(Counter(linked(prints).values()).values()) > 20


def dense(seed, n):
    """Fingerprints round a few centres, so that tiles are crowded, and others far from all."""
    gen = random.Random(seed)
    centres = [gen.getrandbits(64) for _ in range(3)]
    out = {gen.getrandbits(64) for _ in range(n // 4)}
    while len(out) < n:
        p = gen.choice(centres)
        for _ in range(gen.randrange(7)):
            p ^= 1 << gen.randrange(64)
        out.add(p)
    return sorted(out)


@pytest.mark.parametrize(("meeting", "radius"), [(400, 2), (17, 2), (60, 1)])
def test_links_of_crowded_tiles(spark, meeting, radius):
    prints = list(enumerate(dense(meeting, 900)))
    classes = spark.createDataFrame([(int(np.uint64(p).view(np.int64)), i) for i, p in prints], "print long, first long")
    from quarry.llm.components import components

    got = {i: i for i, _ in prints}
    got.update({r["id"]: r["component"] for r in components(simhash.near_links(classes, radius, meeting)).collect()})
    assert got == linked(prints, radius)


def test_meetings_of_large_tiles():
    """The comparison of whole tiles gives the components of a plain one."""
    centre = np.uint64(0x0F0F0F0F0F0F0F0F)
    prints = np.unique(np.array([centre ^ np.uint64(1 << a) ^ np.uint64(1 << b) for a in range(64) for b in range(64)], np.uint64))
    rows, at = simhash.around(simhash.tiles(prints, 8), 8)
    order = np.argsort(at, kind="stable")
    rows, at = rows[order], at[order]
    assert np.unique(at, return_counts=True)[1].max() > simhash._FEW
    pairs = rows[simhash._meeting_links(at, prints[rows], 8, 2)]
    assert (np.bitwise_count(prints[pairs[:, 0]] ^ prints[pairs[:, 1]]) > 0).all()
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs.tolist():
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert [find(k) for k in range(len(prints))] == list(linked([(k, int(p)) for k, p in enumerate(prints)]).values())


def test_fingerprint_of_pieces(monkeypatch):
    text = "One two  three\nfour five " * 50 + "y" * 70 + " six"
    want = plain_print(text)
    for piece in (1, 7, 30, 64):
        monkeypatch.setattr(simhash, "PIECE", piece)
        assert simhash.fingerprint(text.encode()) == want
        assert simhash.fingerprint(b"one  two") == plain_print("one two") and simhash.fingerprint(b" ") == 0


def test_repeated_and_null_ids(spark):
    texts = ["a b c d", "a b c d", "q r s t u v w", None]
    rows = simhash.near_duplicates(docs_of(spark, texts, [5, None, 5, None])).collect()
    assert len(rows) == 4 and {r["component_id"] for r in rows if r["doc_id"] == 5} == {5}
    assert sorted(str(r["component_id"]) for r in rows if r["doc_id"] is None) == ["5", "None"]


def test_empty_tables(spark):
    none = docs_of(spark, []).where("false")
    assert phrases.collocations(none).collect() == [] and merkle.manifest(none).collect() == [] and simhash.near_duplicates(none).collect() == []
