"""The training-data operators against brute force on small tables with nulls, ties, repeats and long texts."""

import hashlib
import math
import random
import re
import struct
import tracemalloc
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orderloom.llm import byte_bpe, decontaminate, exact_topk, language_id, near_dedup, sharding, substring_dedup, toxicity, transcripts, url_filter, words

SCHEMA = "doc_id long, text string, lang string, score double, spans string"  # with clashing names


def _fold(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or ""))


def _corpus():
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdefghé") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage, base = text(70), text(200).split(" ")
    rows = [None, "", " \n\t ", "one", "one two", "One  TWO", text(3), text(3000), "!?", passage]
    rows += [text(rng.randint(1, 120)) for _ in range(20)] + [text(20) + "\n" + passage + "  " + text(30) for _ in range(6)]
    for _ in range(40):  # near copies
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        rows.append(" ".join(w))
    rows += [" ".join(base)] * 5
    out = [(100 + i, t, "xx", 0.5, "s") for i, t in enumerate(rows)]
    rng.shuffle(out)
    return [*out, out[3], (None, text(60), "xx", None, None)]


@pytest.fixture(scope="module")
def corpus():
    return _corpus()


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _components(rows, n, percent):
    """Of each row, by comparing all pairs: its shingle set, and the smallest id in reach (None if there is none)."""
    sets, part = [], list(range(len(rows)))
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", _fold(t))
        sets.append({tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))

    def root(x):
        while part[x] != x:
            x = part[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            k = len(sets[a] & sets[b])
            if k and 100 * k >= percent * len(sets[a] | sets[b]) or rows[a][0] is not None and rows[a][0] == rows[b][0] and sets[a] == sets[b]:
                part[root(a)] = root(b)
    low = {}
    for x, (i, _) in enumerate(rows):
        low[root(x)] = min((y for y in (low.get(root(x)), i) if y is not None), default=None)
    return sets, [low[root(x)] for x in range(len(rows))]


def _near_rows(got):
    return sorted((repr(r["doc_id"]), r["n_shingles"], repr(r["component_id"]), r["kept"]) for r in got)


def _near_wanted(rows, n, percent):
    sets, low = _components(rows, n, percent)
    return sorted((repr(i), len(s), repr(c), i == c or c is None) for (i, _), s, c in zip(rows, sets, low, strict=True))


@pytest.mark.parametrize("n, percent", [(3, 85), (5, 80)])
def test_near_duplicates(docs, corpus, empty, n, percent):
    assert _near_rows(near_dedup.near_duplicates(docs, shingle_words=n, percent=percent).collect()) == _near_wanted([r[:2] for r in corpus], n, percent)
    assert near_dedup.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("n, percent, vocabulary", [(3, 85, 3), (3, 85, 500), (5, 80, 20)])
def test_near_duplicates_of_one_text(spark, n, percent, vocabulary):
    """Edits of few texts on both sides of the threshold: lists that hold many components; some rows have no id."""
    rng = random.Random(vocabulary)
    bases = [[f"b{k}w{j}" for j in range(length)] for k, length in enumerate((40, 90, 90))]
    rows = []
    for i in range(300):
        words = list(rng.choice(bases))
        for _ in range(rng.randrange(8)):
            words[rng.randrange(len(words))] = f"v{rng.randrange(vocabulary)}"
        rows.append((None if i % 7 == 0 else i, " ".join(words[rng.randrange(4) :])))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle_words=n, percent=percent).collect()
    assert _near_rows(got) == _near_wanted(rows, n, percent)
    assert len({r["component_id"] for r in got}) > 20


def test_near_duplicates_through_a_row_without_id(spark):
    """Two documents that only a row without id connects; rows without ids that reach none."""
    w = [f"w{j}" for j in range(60)]
    bridge = [*w[:57], "x1", "x2", "x3"]
    rows = [(1, " ".join(w)), (None, " ".join(bridge)), (2, " ".join(["y1", "y2", "y3", *bridge[3:]])), (None, "only one"), (None, "only one")]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle_words=3, percent=85).collect()
    assert _near_rows(got) == _near_wanted(rows, 3, 85)
    assert {r["component_id"] for r in got if r["doc_id"]} == {1}


def test_sharding(spark, docs, corpus, empty):
    rows = corpus + [(5000 + i, f"t{i % 700}" * (1 + i % 9), "xx", 0.1, None) for i in range(1500)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA + ", shard long, size long")
    text = {i: t or "" for i, t, *_ in rows}
    groups = {}
    for _, t, *_ in rows:
        groups[t or ""] = groups.get(t or "", 0) + len((t or "").encode()) + 1
    want = [0] * 8
    for group, shard in sharding.schedule(groups.items(), 8):
        want[shard] += groups[group]
    for how in ({}, {"rows_per_bucket": 100, "large": 3}):
        got = sharding.assign_shards(df, **how).collect()
        assert len(got) == len(rows)
        where = {}
        for r in got:
            t = text[r["doc_id"]]
            assert (r["size"], r["text_crc32"], r["law"]) == (len(t.encode()) + 1, zlib.crc32(t.encode()), "bytes")
            assert where.setdefault(t, r["shard"]) == r["shard"]
        for s in range(8):
            slots = sorted(r["slot"] for r in got if r["shard"] == s)
            assert slots == list(range(len(slots)))
        assert [sum(r["size"] for r in got if r["shard"] == s) for s in range(8)] == want
    assert sharding.assign_shards(empty).count() == 0


def test_schedule_by_classes():
    """What the heap gives one group after another, class by class."""
    assert sharding.schedule([(1, 5), (2, 4), (3, 3), (4, 3)], 2) == [(1, 0), (2, 1), (3, 1), (4, 0)]
    rng = random.Random(1)
    for _ in range(200):
        shards = rng.randint(1, 9)
        size = {i: rng.choice([1, 2, 3, 50, 400, rng.randint(1, 30)]) for i in range(rng.randint(0, 200))}
        if rng.random() < 0.3:
            size[999] = rng.randint(500, 5000)
        want = {}
        for i, s in sharding.schedule(size.items(), shards):
            want.setdefault(size[i], [0] * shards)[s] += 1
        assert sharding.schedule_classes(Counter(size.values()).items(), shards) == want


def test_urls(spark):
    urls = ["http://A.Example.org/es/1?x", "https://org/", "http://example.org/en/12#t", "http://xorg/fr/", "http://a.com/de/2", "http://a.com/fr/2", "nourl", None, "http://b.com?q=/de/", "HTTP://É.net/p?x=1&y"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)] + [(0, urls[0], "x")], "page_id long, url string, score string")
    got = {r["page_id"]: tuple(r)[1:5] for r in url_filter.filter_urls(pages).collect()}
    assert got[0] == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert got[1] == ("org", "/", "org/", "allow") and got[2][2:] == ("example.org/en/1", "block")
    assert got[3][:3] == ("xorg", "/fr/", None) and got[4][2:] == ("com/de/", "block") and got[5][2:] == ("com/fr/", "allow")
    assert got[6][:3] == ("", "", None) and got[7][:3] == ("", "", None) and got[8][:3] == ("b.com", "", None) and got[9][0] == "É.net"
    assert url_filter.filter_urls(pages.limit(0)).count() == 0


def test_urls_against_plain_rules(spark):
    """host, path and rule of many odd URLs by string functions."""
    rng = random.Random(12)
    pieces = ["http", "://", "://", "/", "?", "#", "a.", "Example", ".org", "org", ".com", "com", "/es/", "/en/1", "/fr/", "/de/", "x" * 3000, "é", "\n", " "]
    urls = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 9))) for _ in range(600)]
    urls += [f"http://{rng.choice(['', 'www.', 'x'])}{rng.choice(['example.org', 'EXAMPLE.com', 'org', 'com'])}{rng.choice(['/es/', '/en/1', '/fr/', '/de/', '/', ''])}q" for _ in range(200)]

    def want(url):
        host = path = ""
        if "://" in url:
            tail = url.split("://", 1)[1]
            stop = min((tail.index(c) for c in "/?#" if c in tail), default=len(tail))
            host, rest = _fold(tail[:stop]), tail[stop:]
            path = rest[: min((rest.index(c) for c in "?#" if c in rest), default=len(rest))]
        fits = [(len(h + p), verdict, h + p) for verdict, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *(max(fits)[:0:-1] if fits else (None, None)))

    got = url_filter.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()
    for r in got:
        w = want(urls[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == w[:3] and (w[3] is None or r["verdict"] == w[3]) and r["verdict"] in ("allow", "block")


def test_url_features():
    urls = ["http://A.bc.org/x/y1?p=1&q=2&r#z", "", "no url", "http://h", "ab://c.d?x#y", "http://a.b/#q?x&y", "x" * 5000 + "://k.l.m/" + "9" * 70]
    got, suffixes = url_filter.lexical_features(*url_filter.utf8(pa.array([*urls, None], pa.string())))
    for row, url in zip(got.tolist(), [*urls, ""], strict=True):
        tail = url.split("://", 1)[1] if "://" in url else ""
        host = re.split("[/?#]", tail)[0]
        path, _, query = tail[len(host) :].split("#")[0].partition("?")
        n, seen = max(1, len(url)), Counter(url)
        entropy = -sum(c / n * math.log2(c / n) for c in seen.values())
        own = (len(url), len(host), path.count("/"), sum(c.isdigit() for c in url) / n, entropy, query.count("&") + 1 if query else 0, url.count("-"), host.count(".") + 1, sum(c.isupper() for c in url) / n)
        assert row == pytest.approx(own), url
    hosts = [re.split("[/?#]", u.split("://", 1)[1])[0].lower() if "://" in u else "" for u in [*urls, ""]]
    for k in (1, 2):
        names = [".".join(h.split(".")[-k:]) for h in hosts]
        assert len(set(zip(names, suffixes[:, k - 1].tolist(), strict=True))) == len(set(names)) == len(set(suffixes[:, k - 1].tolist()))


def test_urls_learn(spark):
    rng = random.Random(2)
    rows = [(f"http://{'x' * rng.randint(20, 30)}{rng.randint(100, 999)}.biz/a/b/c?p=1&q=2", 1) if k % 2 else (f"http://site{rng.choice('abc')}.net/page", 0) for k in range(400)]
    told = spark.createDataFrame(rows[:300], "url string, label int")
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows[300:])], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.filter_urls(pages, rules=(), labelled=told).collect()}
    assert all(got[i] == ("block" if y else "allow") for i, (_, y) in enumerate(rows[300:]))


def test_toxicity(spark):
    rng = random.Random(3)
    rows = []
    for i in range(300):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(30)]
        bad = i % 3 == 0
        if bad:
            words[rng.randrange(30)] = rng.choice(["zwurfel", "quonkins"])
        rows.append((i, " ".join(words), int(bad)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i < 200], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert all((got[i] >= 0.5) == bool(y) for i, _, y in rows if i >= 200)
    odd = spark.createDataFrame([(1, "so zwur.fel"), (2, "qu o nkins"), (3, None), (4, ""), (5, "z w u r f e l now"), (6, "zwurrfel")], "doc_id long, text string")
    s = {r["doc_id"]: r["score"] for r in toxicity.score(odd, model).collect()}
    assert s[3] == s[4] < 0.5 and s[1] > s[3] and s[5] > s[3] and s[6] > 0.5
    assert toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).where("score between 0 and 1").count() == 300


def _judge(spark, rows, asked):
    """Scores of texts by a model fitted on (id, text, toxic) rows."""
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"))
    got = toxicity.score(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), model).collect()
    return model, [r["score"] for r in sorted(got)]


def _kernel(a, b):
    """Normalised gap-weighted kernel by listing all subsequences of three letters with gaps up to two."""

    def phi(w):
        out = Counter()
        for i in range(len(w)):
            for j in range(i + 1, min(i + 4, len(w))):
                for k in range(j + 1, min(j + 4, len(w))):
                    if all(unicodedata.category(w[x])[0] in "LM" for x in (i, j, k)):
                        out["".join(w[x].casefold() for x in (i, j, k))] += 0.5 ** (k - i - 2)
        return out

    x, y = phi(a[:24]), phi(b[:24])
    length = math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
    return sum(v * y[key] for key, v in x.items()) / length if length else 0.0


def test_toxicity_kernel():
    """Features are the best kernel values of a text's words, from the floor on."""
    rng = random.Random(10)
    marks = ["zwurfel", "quonkins", "crétîné", "дурачина", "aaaaa"]
    words = ["".join(rng.choice("zwurfelqonkisé.") for _ in range(rng.randint(3, 14))) for _ in range(400)] + ["z.wurfel", "zwurrfel", "QUONKINS", "quon-kins", "aaaa", "дура.чина", "abcdef"]
    texts = [" ".join(words[i : i + 5]) for i in range(0, len(words), 5)] + [""]
    got = toxicity.Landmarks(marks).features(*url_filter.utf8(pa.array(texts)))
    for row, text in zip(got, texts, strict=True):
        for value, mark in zip(row.tolist(), marks, strict=True):
            best = max((_kernel(w, mark) for w in text.split()), default=0.0)
            assert value == pytest.approx(best if best >= toxicity.FLOOR else 0.0, abs=1e-5) or abs(best - toxicity.FLOOR) < 1e-6


def test_toxicity_of_odd_tables(spark):
    rows = [(i, f"so {'zwurfel' if i % 2 else 'fine'} n{i} there", 7.0, "x") for i in range(40)] + [(1, "so zwurfel n1 there", 7.0, "x"), (None, "zwurfel", 0.0, "y"), (50, "zwurfel " * 100_000, 0.0, "z"), (51, "a" * 300_000, 0.0, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, predicted string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(3, 1), (3, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) and sum(r["doc_id"] == 1 for r in got) == 2
    s = {r["doc_id"]: r["score"] for r in got}
    assert s[50] > 0.5 and s[None] > 0.5 > s[51] and all(0 <= x <= 1 for x in s.values())
    assert toxicity.score(docs.limit(0), model).count() == 0
    one = toxicity.fit(docs, labels.where("toxic = 1"))
    assert toxicity.score(docs, one).where("score between 0 and 1").count() == len(rows)
    assert toxicity.score(docs, toxicity.fit(docs.limit(0), labels)).where("score between 0 and 1").count() == len(rows)


def test_toxicity_of_any_letters(spark):
    rng = random.Random(7)
    rows = []
    for i in range(240):
        words = ["".join(rng.choice("abcdefghéèжщя") for _ in range(rng.randint(2, 7))) for _ in range(30)]
        if i % 3 == 0:
            words[rng.randrange(30)] = ["crétîné", "ДУРАЧИНА", "ηλίθιος"][i // 3 % 3]
        rows.append((i, " ".join(words), int(i % 3 == 0)))
    bad = ["un crétîné là", "CRÉTÎNÉ", "эй дурачина", "д у р а ч и н а", "дура.чина", "ω ηλίθιος"]
    clean = ["é î é â ô ê è", "щщщ жяжя", "ααα ββββ", ""]
    _, got = _judge(spark, rows, bad + clean)
    assert min(got[: len(bad)]) > 0.5 > max(got[len(bad) :])
    data = "aé日🙂\0ß".encode()
    points, before = toxicity.code_points(__import__("numpy").frombuffer(data, "uint8"))
    assert points.tolist() == [ord(c) for c in data.decode()] and before[-1] == 6


def test_toxicity_keeps_texts_of_common_words(spark):
    """Different texts that share all their common words are all learnt from."""
    rng = random.Random(8)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(40)]
    text = lambda *more: " ".join(rng.sample([*vocab, *more], len(vocab) + len(more)))
    insults = ["zwurfel", "quonkins", "plojimur", "vyxostit"]
    rows = [(i, text(insults[i // 3 % 4]) if i % 3 == 0 else text(), int(i % 3 == 0)) for i in range(120)]
    _, got = _judge(spark, [*rows, *((1000 + i, t, y) for i, t, y in rows[:30])], [*(text(w) for w in insults), text(), text()])
    assert min(got[:4]) > 0.5 > max(got[4:])


def test_toxicity_spreads_landmarks(spark):
    """Forms of one stem in many texts leave a place to an insult in few (but more than chance would make)."""
    rng = random.Random(9)
    word = lambda letters="abcdefgh": "".join(rng.choice(letters) for _ in range(rng.randint(2, 7)))
    forms = sorted({"zwurfel" + word() for _ in range(80)})
    bad = [forms[i % len(forms)] for i in range(6 * len(forms))] + ["quonkins"] * 24
    rows = [(i, " ".join(word() for _ in range(20)) + (f" {bad[i]}" if i < len(bad) else ""), int(i < len(bad))) for i in range(2 * len(bad))]
    model, got = _judge(spark, rows, ["so quonkins", "zwurfelab", "abc defg"])
    assert "quonkins" in model.landmarks.words and min(got[:2]) > 0.5 > got[2]
    taken = toxicity.spread(iter([*forms, "quonkins", "vyxostit"]), 32)
    assert len(taken) == 32 and {"quonkins", "vyxostit"} <= set(taken)


def test_topk(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([-1.0, -0.5, 0.25, 0.75]) for _ in range(4)]) for i in range(700)] + [(900, None), (950, [1.0, None, 0.0, 0.0]), (1000, [float("nan")] * 4), (None, [1.0] * 4), (50, rows_0 := [1.0] * 4)]
    rows = [r for r in rows if r != (50, rows_0)]
    rows.append(rows[50])
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(map(tuple, exact_topk.top_k(df, rows_per_shard=100, queries_per_block=4).collect()))
    v = {i: [int(256 * x // 1) for x in e] for i, e in rows if i is not None and e and None not in e and e[0] == e[0]}
    want = []
    for q in v:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(v[q], e, strict=True)), i) for i, e in v.items() if i != q)[:5]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert got == sorted(want)
    odd = df.select("vec_id", "embedding", F.lit(1).alias("score"), F.lit("x").alias("id")).unionByName(spark.createDataFrame([(2000, [1.0] * 3, 1, "x"), (2050, [], 1, "x")], "vec_id long, embedding array<float>, score int, id string"))
    assert sorted(map(tuple, exact_topk.top_k(odd, rows_per_shard=30, queries_per_block=2, blocks_per_run=3).collect())) == got
    assert exact_topk.top_k(df.limit(0)).count() == 0
    assert exact_topk.top_k(df.where("vec_id in (50, 51)")).count() == 1


def test_language(spark, docs, empty):
    en, de = "the quick brown fox jumps over the lazy dog and the cat ", "der schnelle braune fuchs springt über den faulen hund und die katze "
    rows = [(i, (en if i % 2 else de) * (1 + i % 3), "en" if i % 2 else "de") for i in range(20)]
    p = language_id.learn_profiles(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    asked = spark.createDataFrame([(1, "THE DOG and the fox", "x"), (2, "die katze über den hund", "x"), (3, None, "x"), (4, "123 !?", "x"), (5, "", "x"), (6, en * 3000, "x")], "doc_id long, text string, score string")
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(asked, p).collect()}
    assert got == {1: "en", 2: "de", 3: "und", 4: "und", 5: "und", 6: "en"}
    assert language_id.identify(docs, p).count() == docs.count() and language_id.identify(empty, p).count() == 0
    nothing = language_id.learn_profiles(empty)
    assert {r["lang_pred"] for r in language_id.identify(asked, nothing).collect()} == {"und"}


def _profile(text, size=400, longest=3):
    """The most frequent grams of padded lower-cased words of letters, ties to the smaller code of the operator's own."""
    counts = Counter()
    for word in re.findall(r"[^\W\d_]+", text):
        w = f" {''.join(c.lower() if len(c.lower()) == 1 else c for c in word)} "
        for n in range(1, longest + 1):
            counts.update(w[i : i + n] for i in range(len(w) - n + 1) if w[i : i + n] != " ")
    return counts


def _code(gram):
    """The operator's code of a gram, from a text that has it."""
    value = 0
    for c in gram:
        value = (value * 0x9E3779B97F4A7C15 + (1 if c == " " else ord(c) + 2)) % 2**64
    return (value * 0xD6E8FEB86659FD93 % 2**64) >> 20


def _ranks(counts, size=400):
    return {g: r for r, g in enumerate(sorted(counts, key=lambda g: (-counts[g], _code(g)))[:size])}


def _language(text, profiles, size=400):
    own = _ranks(_profile(text or ""), size)
    far = {lang: sum(abs(r - p[g]) if g in p else size for g, r in own.items()) for lang, p in sorted(profiles.items())}
    return min(far, key=far.get) if own else "und"


def _profiles(rows, size=400):
    counts = {}
    for lang, text in rows:
        counts.setdefault(lang, Counter()).update(_profile(text or ""))
    return {lang: _ranks(c, size) for lang, c in counts.items()}


def test_language_against_plain_profiles(spark, corpus):
    rng = random.Random(11)
    langs = {lang: ["".join(rng.choice(letters) for _ in range(rng.randint(1, 7))) for _ in range(60)] for lang, letters in (("a", "abcdeé"), ("b", "abcxyz"), ("c", "дежзи"), ("d", "abcdef"))}
    rows = [(i, " ".join(rng.choice(langs[lang]) for _ in range(rng.randint(0, 80))) + rng.choice(["", " 12", "_x!", "İß"]), lang) for i in range(120) for lang in [rng.choice("abcd")]]
    rows += [(None, "abc dda", "a"), (None, None, "b"), (200, "xx", None), (201, "zz zz", "b")]
    for size in (400, 20):
        model = language_id.learn_profiles(spark.createDataFrame(rows, "doc_id long, text string, lang string"), size=size)
        mine = _profiles([(lang, t) for _, t, lang in rows if lang and t is not None], size)
        asked = [t for _, t, *_ in rows] + [t for _, t, *_ in corpus] + ["", "a", "ж", "abc " * 5000]
        got = language_id.identify(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), model).collect()
        assert [r["lang_pred"] for r in sorted(got)] == [_language(t, mine, size) for t in asked]
        tie = language_id.learn_profiles(spark.createDataFrame([(1, "ab", "y"), (2, "ab", "x")], "doc_id long, text string, lang string"))
        assert language_id.identify(spark.createDataFrame([(1, "ab")], "doc_id long, text string"), tie).first()["lang_pred"] == "x"


def test_bpe(spark, docs, corpus, empty):
    P = pytest.importorskip("public_tokenizers")
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    odd = ["a" * 20_000, " x", "a  b \n c ", "it's <unk> ▁ ⁇", "日本🙂‍👩", "\0a \x1c b", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "doc_id long, text string").union(docs.select("doc_id", "text"))
    text = dict(enumerate(odd)) | {i: t for i, t, *_ in corpus}
    for r in byte_bpe.encode_decode(df, path, P.PATTERN).collect():
        t = text[r["doc_id"]] or ""
        ids = enc.encode_ordinary(t)
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and bytes(r["decoded"]) == t.encode() and bytes(r["ids_le"]) == struct.pack(f"<{len(ids)}I", *ids)
    assert byte_bpe.encode_decode(empty, path, P.PATTERN).count() == 0


def _cut_repeats(rows, window):
    """(id or 2**63, words, removed, kept words) of each row, from a table of all windows."""
    words = [(2**63 if i is None else i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        for j in range(len(w) - window + 1):
            k = tuple(w[j : j + window])
            first[k] = min(first.get(k, i), i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if first[tuple(w[j : j + window])] < i:
                gone[j : j + window] = [True] * window
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize("window, how", [(50, {}), (6, {}), (51, {"parts": 3}), (1, {}), (7, {"hash_bits": 4, "parts": 2})])
def test_repeats(docs, corpus, empty, window, how):
    """With ``hash_bits`` nearly all windows meet under one hash, and the second one tells them apart."""
    got = substring_dedup.remove_repeats(docs, window=window, **how).collect()
    mine = sorted((2**63 if r[0] is None else r[0], r[1], r[2], " ".join(re.findall(r"[^\x20\x09-\x0D]+", r["kept_text"]))) for r in got)
    assert mine == sorted(_cut_repeats([r[:2] for r in corpus], window))
    assert all(r["extra"]["lang"] == "xx" for r in got) and substring_dedup.remove_repeats(empty).count() == 0


def test_repeats_of_odd_tables(spark):
    rng = random.Random(13)
    line = " ".join(f"w{j}" for j in range(60))
    rows = [(i, f"a{i} {line} b{i}") for i in range(400)] + [(-5, line), (2**63 - 1, line), (None, line), (3, f"a3 {line} b3"), (700, " ".join(rng.choice("xyz") for _ in range(30_000)))]
    rows.append((701, " ".join([*(f"w{j}" for j in range(25)), "other", *(f"w{j}" for j in range(26, 51))])))
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), parts=4).collect()
    assert sorted((repr(r[0]), r[1], r[2]) for r in got) == sorted((repr(i), n, k) for (i, _), (_, n, k, _) in zip(rows, [(2**63 - 1 if x[0] == 2**63 else x[0], *x[1:]) for x in _cut_repeats([(2**63 - 1 if i is None else i, t) for i, t in rows], 50)], strict=True))
    with pytest.raises(ValueError):
        substring_dedup.remove_repeats(spark.createDataFrame(rows[:1], "doc_id long, text string"), window=0)


def test_decontamination(spark, docs, corpus, empty):
    texts = [t for _, t, *_ in corpus if t]
    items = [(1, " ".join(texts[8].split()[:30])), (2, "One TWO"), (3, ""), (4, None), (5, " ".join(texts[20].upper().split()[:14])), (6, "zz qq"), (None, "one"), (2, "One TWO"), (7, "one")]
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", _fold(t))
    wins = {}
    for i, t in items:
        w = find(t)
        for j in range(len(w) - min(13, len(w)) + 1 if w else 0):
            wins.setdefault(tuple(w[j : j + min(13, len(w))]), set()).add(i)
    want = []
    for i, t, *_ in corpus:
        w = find(t)
        hit, seen = [0] * len(w), set()
        for k, ids in wins.items():
            for j in range(len(w) - len(k) + 1):
                if tuple(w[j : j + len(k)]) == k:
                    hit[j : j + len(k)] = [1] * len(k)
                    seen |= ids
        want.append((i or 0, len(w), sum(hit), sorted(seen - {None}), sum(hit) > 0 and 20 * sum(hit) >= len(w)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.decontaminate(docs, bench).collect()
    assert sorted((r[0] or 0, *tuple(r)[1:]) for r in got) == sorted(want)
    assert decontaminate.decontaminate(empty, bench).count() == 0 and decontaminate.decontaminate(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    index = decontaminate.build_index(docs)
    spans = lambda df: sorted(map(repr, df.drop("shard").distinct().collect()))
    whole = spans(decontaminate.search(index, bench))
    assert whole and {r for n in (1, 3) for r in spans(decontaminate.search(index, bench.where("item_id <> 5 and item_id <> 1"), windows_per_block=n))} < set(whole)
    clash = docs.select("doc_id", "text", F.lit(1).alias("n_hit"), F.lit(2).alias("shard"), F.lit(3).alias("item_id"))
    assert sorted(map(repr, decontaminate.decontaminate(clash, bench).collect())) == sorted(map(repr, got))


def _spans(words, terms, width):
    """Spans of at most ``width`` words that hold all terms and no smaller such span."""
    whole = [(a, b) for a in range(len(words)) for b in range(a + 1, min(a + width, len(words)) + 1) if set(terms) <= set(words[a:b])]
    return [s for s in whole if not any(t != s and s[0] <= t[0] and t[1] <= s[1] for t in whole)]


def test_proximity(spark):
    rng = random.Random(14)
    texts = [" ".join(rng.choice("abcdefg") for _ in range(rng.randint(0, 60))) for _ in range(30)] + ["a x b y c z z z z a", None]
    items = [(1, "c a b"), (2, "g g a"), (3, "d"), (4, "q a"), (None, "f e")]
    index = decontaminate.build_index(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1))
    for width in (3, 6):
        got = decontaminate.search(index, spark.createDataFrame(items, "item_id long, text string"), width=width).collect()
        want = {(d, i, *s) for d, t in enumerate(texts) for i, x in items for s in _spans((t or "").split(), x.split(), width)}
        assert {(r["doc"], r["item_id"], r["first"], r["after"]) for r in got} == want and len(got) == len(want)


def test_chat(spark):
    rng = random.Random(6)
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", ("q " * rng.randint(1, 5) if t % 2 == 0 else "answer words " * rng.randint(20, 40)).strip()) for c in range(60) for t in range(rng.randint(1, 9))]
    df = spark.createDataFrame(rows + [(None, 0, None, "User: hi"), (7000, None, None, None), rows[0]], "conv_id long, turn long, role string, text string")
    chain = transcripts.fit_chain(df)
    got = transcripts.recover_turns(df, chain).collect()
    assert len(got) == df.count()
    role = {(c, t): r for c, t, r, _ in rows}
    told = [r for r in got if (r["conv_id"], r["turn"]) in role]
    assert sum(r["role_pred"] == role[r["conv_id"], r["turn"]] for r in told) > 0.95 * len(told)
    key = lambda r: (r["conv_id"] is None, r["conv_id"], r["turn"] is None, r["turn"], r["role_pred"], r["rendered"])
    assert sorted(map(key, transcripts.recover_turns(df, chain, chunk=2).collect())) == sorted(map(key, got))
    assert all(r["rendered"].startswith(f"<|{r['role_pred']}|>\n") == r["starts_turn"] for r in got)
    assert transcripts.recover_turns(df.limit(0), chain).count() == 0
    raw = spark.createDataFrame([(1, "User: hello there\nAssistant: hi\nmore\n\nUser: bye")], "conv_id long, text string")
    assert [r["text"] for r in transcripts.blocks_of(raw, "conv_id", "text").orderBy("turn").collect()] == ["User: hello there", "Assistant: hi\nmore", "User: bye"]


def _likeliest(chain, symbols):
    """A best path by dynamic programming in plain Python, and its score."""
    k = len(chain.roles)
    best = [(chain.start[s] + chain.show[s, symbols[0]], [s]) for s in range(k)]
    for o in symbols[1:]:
        best = [max((best[a][0] + chain.move[a, s] + chain.show[s, o], best[a][1] + [s]) for a in range(k)) for s in range(k)]
    return max(best)


def _value(chain, symbols, path):
    out = chain.start[path[0]] + chain.show[path[0], symbols[0]]
    for a, b, o in zip(path[:-1], path[1:], symbols[1:], strict=True):
        out += chain.move[a, b] + chain.show[b, o]
    return out


@pytest.mark.parametrize("chunk", [3, 256])
def test_chat_against_plain_viterbi(spark, chunk):
    """Each conversation's roles are a best path, however it is cut; a long one, one turn number, null turns, long texts."""
    rng = random.Random(15)
    chain = transcripts.Chain(["assistant", "system", "user"], *(np.log(np.random.default_rng(1).dirichlet(np.ones(n) * 0.5, size).squeeze() + 1e-12) for n, size in ((3, 1), (3, 3), (transcripts.SYMBOLS, 3))))
    text = lambda: rng.choice(["User: ", "[assistant] ", "", "### System\n", "a: "]) + "w " * rng.choice([1, 30, 90, 300, 600]) + rng.choice(["", "?", "\nx"])
    rows = [(c, t, text()) for c in range(40) for t in range(rng.randint(1, 6))] + [(100, t, text()) for t in range(2000)] + [(101, 7, text()) for _ in range(300)] + [(102, None, text()) for _ in range(300)] + [(103, 0, "x" * 300_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string").repartition(6)
    symbols = {(r["conv_id"], r["turn"], r["text"]): (r["h"], r["o"]) for r in df.select("*", F.xxhash64("text").alias("h"), transcripts.observed(F.col("text")).alias("o")).collect()}
    got = transcripts.recover_turns(df, chain, chunk=chunk).collect()
    assert len(got) == len(rows)
    seen, told = {}, {}
    for c, t, x in rows:
        seen.setdefault(c, []).append((t is not None, t or 0, *symbols[c, t, x]))
    for r in got:
        told.setdefault((r["conv_id"], r["turn"]), []).append(r["role_pred"])
    for c in [*range(40), 100, 103]:
        own = [o for *_, o in sorted(seen[c])]
        path = [chain.roles.index(told[c, t][0]) for _, t, *_ in sorted(seen[c])]
        assert _value(chain, own, path) == pytest.approx(_likeliest(chain, own)[0])
    for c in (101, 102):
        best = _likeliest(chain, [o for *_, o in sorted(seen[c])])[1]
        assert Counter(r for (i, _), roles in told.items() if i == c for r in roles) == Counter(chain.roles[s] for s in best)


def test_chat_keeps_text(spark):
    rows = ["User: a: first option", "User: System: reboot needed", "Answer\nit is so", "### Assistant\nhi", "[user] x", "<|system|> y", "**Human:** z", "usera: b", "me too: yes", None]
    rng = random.Random(17)
    labelled = spark.createDataFrame([(c, t, rng.choice(["user", "assistant"]), "w") for c in range(9) for t in range(5)], "conv_id long, turn long, role string, text string")
    chain = transcripts.fit_chain(labelled)
    df = spark.createDataFrame([(1, i, x, "r", "c") for i, x in enumerate(rows)], "conv_id long, turn long, text string, role_pred string, chunk string")
    got = sorted(transcripts.recover_turns(df, chain).collect(), key=lambda r: r["turn"])
    body = [r["rendered"].removeprefix(f"<|{r['role_pred']}|>\n" if r["starts_turn"] else "").removesuffix("\n") for r in got]
    assert body == ["a: first option", "System: reboot needed", "Answer\nit is so", "hi", "x", "y", "z", "usera: b", "me too: yes", ""]
    assert [got[i]["role_pred"] for i in (0, 1, 3, 4, 6)] == ["user", "user", "assistant", "user", "user"]


def _pipeline_wanted(rows, bench, path, pattern):
    """The five stages in plain Python: sorted (doc_id, n_tokens, digest of the decoded text)."""
    import tiktoken

    learnt = [(lang, t) for i, t, lang in rows if lang and t is not None and not (i is not None and zlib.crc32(str(i).encode()) % 4 == 2) and i is not None]
    profiles = _profiles(learnt)
    rows = [(i, t) for i, t, _ in rows if _language(t, profiles) != "und"]
    _, low = _components(rows, 5, 80)
    gone = {i for (i, _), c in zip(rows, low, strict=True) if i is not None and c != i}
    once, kept = set(), []
    for (i, t), c in zip(rows, low, strict=True):
        if i is None and (c is not None or t in once):
            continue
        once |= {t} if i is None else set()
        if i not in gone:
            kept.append((i, t))
    left = []
    for (i, _), (_, n, removed, words) in zip(kept, _cut_repeats(kept, 50), strict=True):
        if n > removed:
            left.append((i, words))
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", _fold(t))
    wins = {tuple(w[j : j + min(13, len(w))]) for w in (find(t) for t in bench) for j in range(len(w) - min(13, len(w)) + 1) if w}
    clean = []
    for i, t in left:
        w = find(t)
        hit = [0] * len(w)
        for k in wins:
            for j in range(len(w) - len(k) + 1):
                if tuple(w[j : j + len(k)]) == k:
                    hit[j : j + len(k)] = [1] * len(k)
        if not (sum(hit) and 20 * sum(hit) >= len(w)):
            clean.append((i, t))
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    return sorted((repr(i), " ".join(t.split()), len(enc.encode_ordinary(t))) for i, t in clean)


def _pipeline_rows(corpus):
    words = "the of and a in is it was der die das und ist ein nicht zu".split()
    rng = random.Random(16)
    more = [(3000 + k, " ".join(rng.choice(words[:8] if k % 2 else words[8:]) + rng.choice("abc") for _ in range(40)), "en" if k % 2 else "de") for k in range(30)]
    rows = [(i, t and " ".join(t.split(" ")), "xx") for i, t, *_ in corpus] + more
    return rows + [(None, more[0][1], None), (None, "a text of its own that has no id", None), (None, "a text of its own that has no id", None), (3001, more[1][1], "en")]


def test_pipeline(spark, tmp_path, corpus):
    P = pytest.importorskip("public_tokenizers")
    import corpus_pipeline

    rows = _pipeline_rows(corpus)
    bench = [next(t for _, t, *_ in corpus if t and len(t) > 9000)[:400], None, rows[-10][1]]
    spark.createDataFrame([(i, t, lang, "s", len(t or ""), 1, "x") for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long, n_hit int, kept string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(None if k else 1, t) for k, t in enumerate(bench)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert len(corpus_pipeline.STAGES) == 5
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = tmp_path / name
        stage(spark, docs, str(tmp_path)).write.parquet(str(out))
        docs = spark.read.parquet(str(out))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_hit", "kept"]
    texts = docs.select("doc_id", "text").collect()
    path = P.path("byte_bpe_50k.tiktoken")
    want = _pipeline_wanted(rows, [t for t in bench if t], path, P.PATTERN)
    assert sorted((repr(r["doc_id"]), " ".join(r["text"].split())) for r in texts) == [w[:2] for w in want]
    coded = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "n_tokens", "decoded_sha256").collect()
    assert sorted((repr(r["doc_id"]), r["decoded_sha256"]) for r in coded) == sorted((repr(r["doc_id"]), hashlib.sha256(r["text"].encode()).hexdigest()) for r in texts)
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    assert sum(r["n_tokens"] for r in coded) == sum(len(enc.encode_ordinary(r["text"])) for r in texts)


def test_pipeline_of_nothing(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_batches_of_long_texts(spark):
    """Texts go to Python in batches of bounded bytes, in sessions that name no size."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.getAll.get(key)
    docs = spark.range(0, 60, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 100_000).alias("text"))

    def largest():
        def run(batches):
            for b in batches:
                yield pa.record_batch([pa.array([b.nbytes])], names=["n"])

        return words.sized(docs).mapInArrow(run, "n long").agg(F.max("n")).first()[0]

    try:
        spark.conf.unset(key)
        assert largest() < words.BATCH_BYTES + 1_000_000 and spark.conf.get(key) == str(words.BATCH_BYTES)
        spark.conf.set(key, "9000000")
        assert 6_000_000 < largest() < 10_000_000 and spark.conf.get(key) == "9000000"
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def test_languages_judged_in_little_memory():
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choices("abcdefghijklmnopqrst", k=rng.randint(2, 9))) for _ in range(rng.randint(0, 300))) for _ in range(2000)]
    data, at = words.utf8(pa.array([*texts, "", "12 34"]))
    own = [language_id.top_grams(*language_id.grams(*words.utf8(pa.array([t])), 3), 400) for t in texts[:2]]
    gram = np.concatenate([g for _, g, _ in own])
    order = np.argsort(gram, kind="stable")
    every, first = np.unique(gram[order], return_index=True)
    lang, rank = np.repeat([0, 1], [len(g) for _, g, _ in own])[order], np.concatenate([r for _, _, r in own])[order]
    profiles = language_id.Profiles(["a", "b"], every, np.append(first, len(order)), lang, rank, 400, 3)
    language_id.grams(data[:10], np.array([0, 10]), 3)  # the table of letters
    tracemalloc.start()
    langs, score = profiles.judge(data, at)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert at[-1] > 1 << 20 and peak < 40 << 20
    alone = [profiles.judge(data[a:b], np.array([0, b - a])) for a, b in zip(at[:-1], at[1:], strict=True)]
    assert langs == [x[0] for x, _ in alone] and score.tolist() == [float(y[0]) for _, y in alone]
    assert langs[-2:] == ["und", "und"]


def test_bpe_keeps_nothing_after_a_task():
    P = pytest.importorskip("public_tokenizers")
    coder = byte_bpe.ByteBPE(byte_bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), P.PATTERN)
    batch = pa.record_batch([pa.array([1, 2, 3]), pa.array(["one text of some words", None, "words of some text, zzyzxqq"])], names=["doc_id", "text"])
    rows = [r for b in byte_bpe.coded(coder, iter([batch])) for r in b.to_pylist()]
    assert not coder.cache and not coder.words
    assert [r["decoded"] for r in rows] == [b"one text of some words", b"", b"words of some text, zzyzxqq"]
    again = byte_bpe.coded(coder, iter([batch, batch]))
    next(again)
    assert coder.words
    again.close()  # a task that doesn't read to the end
    assert not coder.cache and not coder.words
