"""The operators against brute force, round trips and held-out accuracy, with nulls, empty tables, ties, repeats and clashing names."""

import hashlib
import itertools
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("covista.llm")
from covista.llm import align, anchors, bpe, exact_dedup, lang_id, merkle, mixing, near_dup, queries, quotes, secret_scan, simhash, suffix_dedup, topk, word_repeats  # noqa: E402
from covista.llm.common import components, through_sieve  # noqa: E402

DOC = "doc_id long, text string, lang string, source string, n_chars long, th long, key string, start int, n int"
R = random.Random(11)
WORDS = ["".join(R.choice("abcdefgh") for _ in range(R.randrange(2, 8))) for _ in range(300)]


def prose(n, r=R):
    return " ".join(r.choice(WORDS) for _ in range(n))


def table(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "s", 0, 1, "k", 2, 3) for i, t in rows], DOC)


def corpus():
    a, b = prose(400), prose(120)
    rows = [(1, a), (2, a + " x"), (3, prose(60) + " " + b + " " + prose(50)), (4, b), (5, "y " + b + " " + b), (6, None), (7, ""), (8, " \t\n"), (9, "é" * 90), (10, prose(20)), (11, "-" * 700), (12, "ab " * 150), (13, "z " * 40)]
    for k in range(14, 30):
        p, s = R.randrange(300), prose(R.randrange(5, 60))
        rows.append((k, s + "\n" + " ".join(a.split()[p : p + R.randrange(10, 90)]) + "  " + prose(9)))
    return rows + [(30, rows[9][1]), (None, prose(40))]


def by_id(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def test_identifiers_name_content():
    x = anchors.word_symbols(b"a bb a\tccc \x0b bb  a" + b" q" * 3 + b"x" * 50)
    assert len(x) == 10 - 1 and x[0] == x[2] == x[5] and x[1] == x[4] and len(set(x.tolist())) == 5
    assert (anchors.word_symbols(b"one two three four " * 50, tile=16) == anchors.word_symbols(b"one two three four " * 50)).all()
    y = anchors.byte_symbols(bytes(R.randrange(3) for _ in range(500)))
    start, count, *_ = anchors.runs(y, anchors.Shape(40, 13))
    assert count.sum() == 461 and (start[1:] == start[:-1] + count[:-1]).all()


@pytest.mark.parametrize("size", [5, 16, 35])
def test_word_repeats(spark, size):
    rows = corpus()
    got = by_id(word_repeats.remove_repeats(table(spark, rows), size))
    assert {i: (a, b, hashlib.sha256(k).hexdigest()) for i, (a, b, k) in got.items()} == word_repeats.brute_force(rows, size)


@pytest.mark.parametrize("size", [20, 64, 400])
def test_byte_repeats(spark, size):
    rows = corpus()
    got = by_id(suffix_dedup.remove_repeats(table(spark, rows), size, gram=max(4, size // 3)))
    assert {i: (*x[:3], hashlib.sha256(x[3]).hexdigest()) for i, x in got.items()} == suffix_dedup.brute_force(rows, size)


@pytest.mark.parametrize(("first", "size", "want"), [(9, 35, [9, 18, 35]), (1, 35, [1, 2, 4, 8, 16, 32, 35]), (9, 5, [5]), (8, 16, [8, 16])])
def test_levels_double(spark, first, size, want):
    assert word_repeats.lengths(size, first) == want
    rows = corpus()
    keyed = word_repeats.keyed_texts(table(spark, rows))
    found = {tuple(x) for f in word_repeats.repeated_windows(keyed, size, first) for x in f.select("rid", "start", "n").collect()}
    seen = Counter(tuple(w[k : k + size]) for w in ((t or "").encode().split() for _, t in rows) for k in range(len(w) - size + 1))
    text = {x["rid"]: x["text"].encode().split() for x in keyed.collect()}
    got = {(r, k) for r, s, n in found for k in range(s, s + n)}
    assert got == {(r, k) for r, w in text.items() for k in range(len(w) - size + 1) if seen[tuple(w[k : k + size])] > 1}


def test_repeats_in_texts_longer_than_a_tile(spark):
    r = random.Random(4)
    long = "".join(r.choice("abcdefghijklmnop ") for _ in range(280_000))
    rows = [(1, long), (2, "x" * 90 + long[130_500:131_900] + "y" * 50), (3, long[:500]), (4, None)]
    got = by_id(suffix_dedup.remove_repeats(table(spark, rows)))
    assert {i: (*x[:3], hashlib.sha256(x[3]).hexdigest()) for i, x in got.items()} == suffix_dedup.brute_force(rows)
    words = [(1, " ".join(r.choice(WORDS) for _ in range(140_000)))]
    words.append((2, " ".join(words[0][1].split()[131_000:131_200])))
    got = by_id(word_repeats.remove_repeats(table(spark, words)))
    assert {i: (a, b, hashlib.sha256(k).hexdigest()) for i, (a, b, k) in got.items()} == word_repeats.brute_force(words)


def test_sieves_lose_nothing(spark):
    rows = spark.range(3000).withColumns({"a.b": F.col("id") * 2, "_k": F.lit(1)})
    maybe, out = through_sieve(rows, F.xxhash64("id"), spark.range(0, 3000, 7).select(F.xxhash64("id").alias("h")))
    assert maybe.columns == out.columns == rows.columns
    inside, outside = ({x["id"] for x in d.collect()} for d in (maybe, out))
    assert inside | outside == set(range(3000)) and not inside & outside and set(range(0, 3000, 7)) <= inside and len(inside) < 600
    none, all_ = through_sieve(rows, F.xxhash64("id"), spark.range(0).select("id"))
    assert none.count() == 0 and all_.count() == 3000


def test_a_repeated_row_is_another_place(spark):
    text = prose(50)
    assert [r["n_removed"] for r in word_repeats.remove_repeats(table(spark, [(1, text), (1, text)]), 10).collect()] == [50, 50]
    assert [r["n_removed"] for r in suffix_dedup.remove_repeats(table(spark, [(1, text), (1, prose(50))]), 60).collect()] == [0, 0]


def test_empty_tables(spark):
    none = table(spark, [(1, "a")]).where("doc_id = 2")
    path, pattern = queries.tokenizer()
    for df in (word_repeats.remove_repeats(none), suffix_dedup.remove_repeats(none), exact_dedup.exact_dedup(none), exact_dedup.without_copies(none), near_dup.near_duplicates(none), near_dup.without_near_copies(none), mixing.mix(none), mixing.sample(none), bpe.round_trip(none, path, pattern), bpe.tokenised(none, path, pattern), secret_scan.find_secrets(none), lang_id.identify(none, lang_id.fit(none)), simhash.near_duplicates(none), align.align(none, *files()), merkle.manifest(none)):
        assert df.collect() == []
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 2 == 0).collect() == []
    assert quotes.reply_order(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def test_exact_dedup(spark):
    rows = [(5, "a b"), (2, "ab"), (3, " a  b"), (4, "a b"), (7, None), (8, ""), (6, "\n"), (9, "abc"), (None, "abd"), (10, "x" * 100 + "y"), (11, "x" * 100 + "z"), (12, "x" * 50 + " " + "x" * 50 + "y"), (2, "ab")]
    got = [tuple(r) for r in exact_dedup.exact_dedup(table(spark, rows)).collect()]
    norm = {i: re.sub(r"[\x20\x09-\x0D]", "", t or "") for i, t in rows}
    for i, keep, size, kept, digest in got:
        same = [(t or "", j) for j, t in rows if norm[j] == norm[i]]
        best = min(same, key=lambda x: (-len(x[0]), x[1] is not None, x[1] or 0))[1]
        assert (keep, size, digest) == (best, len(same), hashlib.sha256(norm[i].encode()).hexdigest())
        assert kept == (i == best)
    clash = table(spark, rows).withColumns({"__norm": F.lit(5), "_row": F.lit(6), "a.b": F.lit(7)})
    assert exact_dedup.without_copies(clash).columns == clash.columns and {tuple(x)[-3:] for x in exact_dedup.without_copies(clash).collect()} == {(5, 6, 7)}
    assert {tuple(x)[-3:] for x in near_dup.without_near_copies(clash).collect()} == {(5, 6, 7)}
    left = exact_dedup.without_copies(table(spark, [*rows, (9, "abc"), (9, "abc")]))
    assert left.columns == table(spark, rows).columns
    assert sorted(r["doc_id"] or 0 for r in left.collect()) == sorted(i or 0 for i in {x[1] for x in got if x[1] is not None} | {None})


def test_language_profiles(spark):
    r = random.Random(5)
    kinds = {"aa": "abcde", "bb": "fghij", "cc": "klmno"}
    text = lambda k: " ".join("".join(r.choice(kinds[k]) for _ in range(5)) for _ in range(30))
    rows = [(i, text(k), k) for i in range(30) for k in kinds] + [(99, None, "aa"), (98, "123 !!", "bb"), (97, "abcde", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = lang_id.fit(df, per_language=5)
    got = lang_id.identify(df, profiles).collect()
    assert [x["lang_pred"] for x in got[:90]] == [k for _, _, k in rows[:90]] and all(0 < x["score"] <= 1 for x in got[:90])
    assert [(x["lang_pred"], x["score"]) for x in got[90:92]] == [("und", 0), ("und", 0)]
    assert len(lang_id.keep_known(df, profiles, 0.1).collect()) == 91
    codes, counts = lang_id.grams("Ab, ab")
    want = Counter(w[i : i + n] for w in [" ab ab "] for n in (1, 2, 3) for i in range(len(w) - n + 1) if w[i : i + n].strip())
    assert sorted(counts.tolist()) == sorted(want.values()) and len(codes) == len(want)
    long = text("aa") * 3
    assert all((a == b).all() for a, b in zip(lang_id.grams(long), lang_id.grams(long, tile=50), strict=True))


def test_predictions_against_brute_force(spark):
    r = random.Random(6)
    kinds = {"aa": "abcdef", "bb": "defghi", "cc": "ghiabc"}
    text = lambda k: " ".join("".join(r.choice(kinds[k]) for _ in range(r.randrange(1, 6))) for _ in range(25)) + r.choice([".", "é 1", ""])
    rows = [(i, text(k), k) for i, k in enumerate("aa bb cc".split() * 15)] + [(None, "", "aa"), (7, "x", None), (7, "x", None), (50, "long " * 30_000, "dd")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"score": F.lit(1), "code": F.lit(2), "share": F.lit(3)})

    def profile(texts):
        seen = Counter()
        for t in texts:
            w = " " + re.sub(r"[\W\d_]+", " ", t.lower()).strip() + " "
            seen.update(w[i : i + n] for n in (1, 2, 3) for i in range(len(w) - n + 1) if w[i : i + n].strip() and len(w) > 2)
        # ties by the code points, of shorter ones first
        code = lambda g: int("".join(f"{1 if c == ' ' else ord(c):021b}" for c in g), 2)
        return [g for g, _ in sorted(seen.items(), key=lambda x: (-x[1], code(x[0])))[: lang_id.PROFILE]]

    learned = {k: profile([t for _, t, x in rows if x == k]) for k in ("aa", "bb", "cc", "dd")}

    def slow(t):
        own = profile([t])
        if not own:
            return lang_id.UNKNOWN, 0.0
        far = {k: sum(min(abs(p.index(g) - i), lang_id.PROFILE) if g in p else lang_id.PROFILE for i, g in enumerate(own)) for k, p in learned.items()}
        best = min(far, key=lambda k: (far[k], k))
        return best, 1 - far[best] / (lang_id.PROFILE * len(own))

    got = lang_id.identify(df, lang_id.fit(df)).collect()
    assert len(got) == len(rows)
    for (_, t, _), x in zip(rows, got, strict=True):
        want = slow(t)
        assert x["lang_pred"] == want[0] and abs(x["score"] - want[1]) < 1e-9


def test_every_language_gets_a_profile(spark):
    df = spark.createDataFrame([(i, chr(0x4E00 + i) * 9, f"l{i}") for i in range(600)], "doc_id long, text string, lang string")
    assert len(lang_id.fit(df).languages) == 600


def test_known_rows_keep_their_columns(spark):
    df = table(spark, [(1, "abc def"), (1, "abc def"), (2, None), (3, "12")]).withColumn("a.b", F.lit(4))
    kept = lang_id.keep_known(df, lang_id.fit(df), 0.1, relabel="source")
    assert kept.columns == df.columns and [(x["doc_id"], x["source"], x["a.b"]) for x in kept.collect()] == [(1, "en", 4)] * 2


def test_guess_cost_is_the_cheapest_segmentation():
    def slow(value):
        brute = [0.0]
        for c in value:
            brute.append(brute[-1] + next((x for is_, x in secret_scan.CLASSES if is_(c)), secret_scan.OTHER))
        ends, n, best = secret_scan._spans(value, brute), len(value), float("inf")
        known = {(i, j): min(c for k, c in ends[j] if k == i) for j in range(n + 1) for i, _ in ends[j]}
        for cuts in itertools.product([0, 1], repeat=n - 1):
            at = [0, *[k + 1 for k, c in enumerate(cuts) if c], n]
            spans = list(zip(at, at[1:]))
            for kinds in itertools.product([0, 1], repeat=len(spans)):
                if all(not k or s in known for k, s in zip(kinds, spans)):
                    best = min(best, sum(known[s] if k else brute[s[1]] - brute[s[0]] for k, s in zip(kinds, spans)) + np.log10(2) * (len(spans) - 1))
        return best

    for v in ("pass12", "qwer1999", "aaaab1", "p4ssKey", "abab12", "Zx9"):
        assert abs(secret_scan.guess_cost(v)[0] - slow(v)) < 1e-9, v
    assert secret_scan.guess_cost("password")[0] < 2 < 8 < secret_scan.guess_cost("kX9#fL2$vQ")[0]


def test_plain_words_are_no_secrets(spark):
    words = secret_scan.ranked_words(queries.tokenizer()[0])
    for t in ("Your password is required to continue.", "the token is expired and", "password is incorrect"):
        assert secret_scan.scan(t, ranks=words) == []
    value = "k9!Qz7#mWx" * 3000
    rows = [(1, f'password = "{value}"'), (2, 'api_key: "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda"'), (2, 'api_key: "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda"')]
    got = secret_scan.digests(secret_scan.find_secrets(table(spark, rows), words=queries.tokenizer()[0])).collect()
    assert [(x["n_assign"], x["n_guess"]) for x in got] == [(0, 1), (1, 1), (1, 1)] or [(x["n_assign"], x["n_guess"]) for x in got] == [(0, 0), (1, 1), (1, 1)]


def test_secret_spans(spark):
    text = "é password = 'abc' Token:\"abcdef12\" secret:=x AKIA" + "A" * 16 + " AKIAB " + "0a" * 12 + " pwd: kX9#fL2$vQw; pwd is password1 passphrase is summer"
    found = secret_scan.scan(text)
    assert [k for k, *_ in found] == ["assign", "access", "hex", "guess"]
    assert [text[s:e] for _, s, e in found] == ['Token:"abcdef12', "AKIA" + "A" * 16, "0a" * 12, "kX9#fL2$vQw"]
    got = secret_scan.digests(secret_scan.find_secrets(table(spark, [(1, text), (2, None), (3, "")]))).collect()
    line = ",".join(f"{k}:{s}:{e}" for k, s, e in found)
    assert got[0]["spans"] == line and got[0]["base_sha256"] == hashlib.sha256(line.rsplit(",", 1)[0].encode()).hexdigest()
    assert got[1]["base_sha256"] == hashlib.sha256(b"").hexdigest() and got[1]["n_hex"] == 0


@pytest.mark.parametrize(("text", "values"), [
    ('DB_PASSWORD="k!9#Qz@7mWx"', ["k!9#Qz@7mWx"]), ('client_secret = "k!9#Qz@7mWx"', ["k!9#Qz@7mWx"]), ("dbPass: 'k!9#Qz@7mWx',", ["k!9#Qz@7mWx"]),
    ('{"password":"k!9#Qz@7mWx","token":"abcdef123456"}', ["k!9#Qz@7mWx"]), ("password=k!9#Qz@7mWx&token=abcdef123456", ["k!9#Qz@7mWx"]), ("pwd=k!9#Qz@7mWx,secret=Q7#zk@9!xW", ["k!9#Qz@7mWx", "Q7#zk@9!xW"]),
    ("password: Summer9!k#9Qz@7mWx", ["Summer9!k#9Qz@7mWx"]), ("password=k!9,#Qz@7mWx", ["k!9,#Qz@7mWx"]), ("a compass is k!9#Qz@7mWx", []), ("pwd=" * 9999, []),
])
def test_values_in_credential_contexts(text, values):
    assert [text[s:e] for kind, s, e in secret_scan.scan(text) if kind == "guess"] == values


def test_bpe_chunks_give_the_tokens_of_the_whole_text(spark):
    path, pattern = queries.tokenizer()
    small = bpe.Codec(path, pattern, chunk=40, overlap=8)
    cut = 0
    r = random.Random(7)
    for _ in range(150):
        text = "".join(r.choice(["a", "Word", " ", "  ", "\n", "'ll", "'", "12", "é", "!?", "日本", " ", "😀"]) for _ in range(r.randrange(400)))
        parts = small.encode(text)
        cut += len(parts) > 1
        ids = [t for p in parts for t in p]
        assert ids == small.encoding.encode_ordinary(text) and small.decode(ids) == text.encode()
    assert cut > 30
    rows = [(1, "a" * 50_000), (2, None), (3, ""), (4, prose(9000)), (5, " " * 40_000 + "x")]
    got = {x["doc_id"]: x for x in bpe.round_trip(table(spark, rows), path, pattern).collect()}
    for i, t in rows:
        ids = small.encoding.encode_ordinary(t or "")
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    many = [(i, "".join(r.choice(["Word", " ", "\n", "123456", "é", "😀 "]) for _ in range(r.randrange(200)))) for i in range(60)]
    for x in bpe.encode(table(spark, many), path, pattern, chunk=40, overlap=8).collect():
        assert list(x["ids"]) == small.encoding.encode_ordinary(many[x["doc_id"]][1])
    own = table(spark, rows).withColumns({"ids": F.lit(1), "nth": F.lit(2), "a.b": F.lit(3)}).withColumnRenamed("a.b", "a_b")
    assert [x["a_b"] for x in bpe.tokenised(own, path, pattern, keep=("doc_id", "a_b", "nth")).collect()] == [3] * 5
    tokens = bpe.encode(table(spark, rows), path, pattern)
    assert {x["doc_id"]: bytes(x["bytes"]) for x in bpe.decode(tokens, path, pattern).collect()} == {i: (t or "").encode() for i, t in rows}


def test_signatures_estimate_the_probability_jaccard():
    r = np.random.default_rng(8)
    a = np.unique(r.integers(1, 1 << 62, 200).astype(np.uint64))
    x, y = r.integers(1, 5, len(a)).astype(float), r.integers(1, 5, len(a)).astype(float)
    exact = sum(1 / np.maximum(x / x[i], y / y[i]).sum() for i in range(len(a)))
    assert abs(near_dup.similarity(a, x, a, y) - exact) < 1e-9
    s = near_dup.signatures([a, a], [x, y], 4096)
    assert abs((s[0] == s[1]).mean() - exact) < 4 * near_dup.agreement(exact, 4096)
    assert near_dup.recall() > 0.9999


def test_near_duplicates_against_all_pairs(spark):
    r = random.Random(9)
    rows = []
    for base in range(6):
        words = prose(80, r).split()
        for _ in range(5):
            copy = list(words)
            for _ in range(r.choice([0, 0, 1, 2, 3])):
                copy[r.randrange(80)] = r.choice(WORDS)
            rows.append((len(rows), "  ".join(copy)))
    rows += [(100, None), (101, ""), (102, "one two"), (103, "one  two"), (104, prose(30, r)), (None, "x"), (7, rows[7][1])]
    cut = {i: near_dup.shingles((t or "").encode()) for i, t in rows if i is not None}
    root = {i: i for i in cut}
    find = lambda i: i if root[i] == i else find(root[i])
    for i, j in itertools.combinations(cut, 2):
        if near_dup.similarity(*cut[i], *cut[j]) >= 0.8:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    want = {i: find(i) for i in cut}
    got = {x["doc_id"]: x for x in near_dup.near_duplicates(table(spark, rows)).collect()}
    assert {i: x["class_id"] for i, x in got.items()} == want
    assert {i: x["class_size"] for i, x in got.items()} == {i: Counter(want.values())[want[i]] for i in want}
    left = near_dup.without_near_copies(table(spark, rows)).collect()
    assert {x["doc_id"] for x in left} == {*want.values(), None}


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (5, 5)]
    got = by_id(components(spark.createDataFrame(edges, "a long, b long")))
    assert got == {**{i: (0,) for i in range(41)}, 100: (100,), 101: (100,), 102: (100,)}


def mixed_rows(r):
    rows = [(i, prose(r.randrange(1, 200), r), r.choice(["en", "en", "fr", None]), r.choice("ppppq")) for i in range(600)]
    return rows + [(700, None, "en", "p"), (701, "", None, None), (None, "a b", "en", "q"), (702, "word " * 20_000, "en", "p")]


def goal(have, weights, budget):
    """Water-filling, one value after the other."""
    have, weights = {k: float(v) for k, v in have.items()}, dict(weights)
    left, out = budget * sum(have.values()), {}
    while True:
        level = left / sum(weights.values())
        full = [k for k in weights if weights[k] * level >= have[k]]
        if not full:
            return out | {k: w * level for k, w in weights.items()}
        for k in full:
            out[k] = have[k]
            left -= have[k]
            del weights[k]


@pytest.mark.parametrize("targets", [None, {"lang": {"en": 3.0, "fr": 1.0}, "source": {"p": 3.0, "q": 1.0}}])
def test_the_sample_has_its_target_marginals(spark, targets):
    rows = mixed_rows(random.Random(10))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = mixing.mix(df, 0.3, targets).toPandas()
    assert len(out) == len(rows) and not out[out.tokens == 0].kept.any()
    total = out.tokens.sum()
    assert abs((out.p * out.tokens).sum() / total - 0.3) < 0.01 and out.p.between(0, 1).all()
    for d in mixing.DIMENSIONS:
        have = {k: v for k, v in out.groupby(d)["tokens"].sum().items() if v}
        given = (targets or {}).get(d)
        want = goal(have, {k: v**mixing.FLATTEN for k, v in have.items()} if given is None else {k: given[k] for k in have if k in given}, 0.3)
        got = (out.p * out.tokens).groupby(out[d]).sum()
        assert all(abs(got[k] / total - want.get(k, 0) / total) < 0.01 for k in have), (d, got, want)


def test_both_ways_of_raking_agree(spark):
    df = spark.createDataFrame(mixed_rows(random.Random(10)), "doc_id long, text string, lang string, source string")
    cells = mixing.cells_of(mixing.described(df))
    by = list(mixing.DIMENSIONS)
    one, steps = (mixing.rake(cells, task_cells=n, tolerance=1e-6).toPandas().sort_values(by) for n in (mixing.TASK_CELLS, 0))
    assert len(one) == len(steps) and np.allclose(one["x"], steps["x"])
    assert (one["x"] <= one["tokens"] + 1e-9).all()


def test_samples_keep_clashing_columns_and_own_topics(spark):
    df = spark.createDataFrame(mixed_rows(random.Random(3)), "doc_id long, text string, lang string, source string").withColumns({"a.b": F.lit(1), "own": F.lit("x"), "topic": F.lit("t"), "p": F.lit(7), "tokens": F.lit(2), "w": F.lit(1)})
    kept = mixing.sample(df, topic=F.col("topic"))
    out = mixing.mix(df, topic=F.col("topic"))
    assert kept.columns == df.columns and kept.count() == out.where("kept").count() and {x[0] for x in out.select("topic").collect()} == {"t"}
    assert {tuple(x)[4:] for x in kept.collect()} == {(1, "x", "t", 7, 2, 1)}


def test_raking_ends_and_tells_where_targets_are_out_of_reach(spark, caplog):
    cells = spark.createDataFrame([("a", "x", "t", 10_000), ("b", "x", "t", 300), ("c", "y", "t", 2)], "source string, lang string, topic string, tokens long")
    assert mixing.rake(cells, 0.5, {"source": {"c": 1.0, "a": 1.0}, "lang": {"x": 1.0}}).count() == 3
    assert "targets out of reach" in caplog.text


def test_top_k(spark):
    r = np.random.default_rng(12)
    rows = [(i, [float(x) for x in r.normal(size=8)]) for i in range(300)] + [(300, None), (301, [None] * 8), (302, [float("nan")] * 8), (303, [float("inf")] * 8), (304, [0.5] * 8), (305, [0.5] * 8), (306, []), (None, [1.0] * 8), (307, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df, F.col("vec_id") % 50 == 0, k=5, pivots=16)
    v = {i: np.pad(np.floor(256 * np.array(x)), (0, 8 - len(x))) for i, x in rows if i is not None and x is not None and (not x or x[0] is not None) and np.isfinite(np.array(x, float)).all()}
    want = []
    for q in (i for i in v if i % 50 == 0):
        best = sorted(((-int(v[q] @ x), i) for i, x in v.items() if i != q))[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted(tuple(x) for x in got.collect()) == sorted(want)
    few = topk.top_k(df.where("vec_id in (0, 1, 2)"), F.col("vec_id") % 50 == 0)
    assert few.count() == 2
    assert topk._scores(np.array([[2.0**30, 1.0]]), np.array([2.0**30, 1.0]))[0] == (1 << 60) + 1
    with pytest.raises(OverflowError):
        topk._scores(np.array([[2.0**40, 1.0]]), np.array([2.0**40, 1.0]))


def test_large_components_lose_no_results(spark):
    rows = [(0, [1.0, 0.0]), (50, [0.5, 0.25]), (3, [0.25, 1.0]), (7, [0.0, 1e160]), (8, [0.0, -1e160]), (100, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(x) for x in topk.top_k(df, (F.col("vec_id") % 50 == 0) & (F.col("vec_id") != 50), k=5).collect())
    v = {i: [int(np.floor(256 * x)) for x in r] for i, r in rows}
    want = []
    for q in (0, 100):
        best = sorted((-sum(a * b for a, b in zip(v[q], x, strict=True)), i) for i, x in v.items() if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want)
    with pytest.raises(Exception, match="(?i)overflow|too large"):
        topk.top_k(df, F.col("vec_id") == 50).collect()


def test_pivots_leave_most_of_clustered_vectors_unread(spark):
    r = np.random.default_rng(2)
    centres = r.normal(size=(40, 16))
    df = spark.createDataFrame([(i, [float(x) for x in centres[i % 40] + r.normal(size=16) * 0.02]) for i in range(4000)], "vec_id long, embedding array<double>").withColumns({"key": F.lit(1), "cell": F.lit(2), "block": F.lit("b"), "v.x": F.lit(3)})
    got = topk.top_k(df, F.col("vec_id") % 50 == 0, with_read=True)
    read = got.where("rank = 1").agg(F.avg("n_read")).first()[0]
    assert read < 0.5 * 4000 and got.count() == 80 * 5


def test_queries_that_share_an_id_are_queries_each(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<double>")
    got = sorted(tuple(x) for x in topk.top_k(df, F.col("vec_id") == 0).collect())
    assert got == [(0, 1, 1, 65536), (0, 1, 1, 65536), (0, 2, 0, 0), (0, 2, 0, 0)]


def test_quotes_link_and_order(spark):
    one, two = "The first message says something long.\nAnd a second line.", "A second paragraph that is quoted later."
    rows = [
        (1, 0, "user", one + "\n\n" + two), (1, 1, "assistant", "> " + two + "\nI agree with that one."), (1, 2, "user", "An aside that is of no matter."),
        (1, 3, "assistant", "> I agree with that one.\n> > a SECOND  paragraph that is quoted later.\nSo do I, as it happens."), (1, 4, "user", ">> nothing that anybody ever said\nWell then, good night."),
        (2, 0, "user", ">The first message says something long.\n> And a second line.\n\nWho wrote this?"), (2, 5, "user", None), (None, 1, "user", "> x"), (3, 0, "user", ""),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("hash", F.lit(1)).withColumn("level", F.lit("x"))
    got = {(x["conv_id"], x["turn"]): x for x in quotes.reply_order(df).collect()}
    parents = {k: (x["parent_turn"], x["by_quote"], x["root_turn"], x["depth"]) for k, x in got.items()}
    assert parents == {(1, 0): (None, False, 0, 0), (1, 1): (0, True, 0, 1), (1, 2): (1, False, 0, 2), (1, 3): (1, True, 0, 2), (1, 4): (3, False, 0, 3), (2, 0): (None, False, 0, 0), (2, 5): (None, False, 5, 0), (None, 1): (None, False, 1, 0), (3, 0): (None, False, 0, 0)}
    assert (got[2, 0]["source_conv"], got[2, 0]["source_turn"]) == (1, 0) and got[2, 0]["text"] == "Who wrote this?"
    assert got[1, 3]["text"] == "So do I, as it happens." and got[1, 4]["n_quoted"] == 1 and got[1, 4]["n_linked"] == 0


def test_short_quotes_link_within_their_conversation(spark):
    rows = [(1, 0, "user", "Yes."), (1, 1, "assistant", "Sounds fine"), (1, 2, "user", "An aside."), (1, 3, "assistant", "> Yes.\nGood."), (1, 4, "user", "> sounds  FINE"), (2, 0, "user", "> Yes.\nWhat?")]
    got = {(x["conv_id"], x["turn"]): x for x in quotes.reply_order(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert {k: (x["parent_turn"], x["by_quote"], x["source_conv"], x["n_quoted"], x["n_linked"]) for k, x in got.items() if k[1] > 2 or k[0] == 2} == {(1, 3): (0, True, None, 1, 1), (1, 4): (1, True, None, 1, 1), (2, 0): (None, False, None, 1, 0)}


def test_quotes_find_the_first_other_conversation(spark):
    line = "A line of more than twelve characters"
    rows = [(1, 2, "user", "> " + line), (2, 0, "user", line), (1, 5, "assistant", line), (3, 1, "user", line), (4, 0, "user", f"> {line}\nSo it is.")]
    got = {(x["conv_id"], x["turn"]): x for x in quotes.reply_order(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert {k: (got[k]["source_conv"], got[k]["source_turn"], got[k]["n_linked"]) for k in [(1, 2), (4, 0)]} == {(1, 2): (2, 0, 1), (4, 0): (1, 5, 1)}


def test_the_statement_of_quotes_says_the_same(spark, tmp_path):
    r = random.Random(8)
    lines = ["Yes.", "Sounds fine", "A line of more than twelve characters", "Another long line, which is quoted too", "> Yes.", "> > Sounds fine", "> A line of more than twelve characters", ">Another long line, which is quoted too", ""]
    rows = [(c, t, r.choice(["user", "assistant"]), "\n".join(r.choice(lines) for _ in range(r.randrange(1, 5)))) for c in range(12) for t in range(6)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = quotes.reply_order(df).withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("parent_turn", "source_conv", "source_turn")})
    df.toPandas().to_parquet(tmp_path / "c.parquet")
    db = duckdb.connect()
    db.execute(f"create view conversations as from '{tmp_path}/c.parquet'")
    want = db.sql(f"select {', '.join(got.columns)} from ({quotes.ORACLE})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_dense_classes_without_a_common_centre(spark):
    """A band of documents, each like its neighbours only: many in a bucket are outside its centre's class."""
    r = random.Random(21)
    base, rows = prose(100, r).split(), []
    for k in range(120):
        words = list(base)
        for p in r.sample(range(100), 6 if k % 3 else 2):
            words[p] = r.choice(WORDS)
        rows.append((k, " ".join(words)))
    cut = {i: near_dup.shingles(t.encode()) for i, t in rows}
    root = {i: i for i in cut}
    find = lambda i: i if root[i] == i else find(root[i])
    for i, j in itertools.combinations(cut, 2):
        if near_dup.similarity(*cut[i], *cut[j]) >= 0.8:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    got = {x["doc_id"]: x["class_id"] for x in near_dup.near_duplicates(table(spark, rows)).collect()}
    assert got == {i: find(i) for i in cut} and len(set(got.values())) > 1


def test_spanning_links_ask_no_more_than_needed():
    asked = []
    links = near_dup.spanning([1, 2], [[3, 4, 5], [4, 5]], {1: 1, 2: 2, 3: 3, 4: 3, 5: 5}, lambda a, b: asked.append((a, b)) or b != 5)
    assert links == [(1, 3), (2, 4)] and asked == [(1, 3), (1, 5), (2, 4), (2, 5)]


CASES = [(5, None), (6, ""), (7, " \t\n"), (8, "One two"), (9, "ONE  two"), (10, "a b c d"), (10, "a b c d"), (None, "a b c d e"), (11, "é Ü ß 漢字 x")]


@pytest.mark.parametrize(("bits", "blocks", "part"), [(4, 6, 1024), (4, 5, 3), (0, 1, 2), (7, 9, 5)])
def test_simhash_against_all_pairs(spark, bits, blocks, part):
    r = random.Random(5)
    rows = list(CASES)
    for base in range(8):
        words = prose(150, r).split()
        for _ in range(12):
            copy = list(words)
            for _ in range(r.randrange(4)):
                copy[r.randrange(150)] = r.choice(WORDS)
            rows.append((100 + len(rows), "  ".join(copy)))
    got = simhash.near_duplicates(table(spark, rows), bits=bits, blocks=blocks, part=part)
    order = lambda x: tuple((v is not None, v) for v in x)
    assert sorted(map(tuple, got.collect()), key=order) == sorted(simhash.brute_force(rows, bits=bits), key=order)


def test_simhash_blocks():
    assert len(simhash.masks()) == 15 and all(20 <= (m & (1 << 64) - 1).bit_count() <= 22 for m in simhash.masks())
    with pytest.raises(ValueError):
        simhash.masks(4, 4)
    r = np.random.default_rng(3)
    x = np.repeat(r.integers(0, 1 << 63, 40, dtype=np.uint64), 5)
    x ^= np.uint64(1) << r.integers(0, 64, len(x), dtype=np.uint64)
    group = np.sort(r.integers(0, 6, len(x)))
    label = simhash.hanging_together(x, group)
    for g in set(group.tolist()):
        at = np.flatnonzero(group == g).tolist()
        root = {k: k for k in at}
        find = lambda k: k if root[k] == k else find(root[k])  # noqa: E731, B023
        for a, b in itertools.combinations(at, 2):
            if (int(x[a]) ^ int(x[b])).bit_count() <= 4:
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
        assert [find(k) for k in at] == label[at].tolist()
    long = (" ".join(WORDS) + " ") * 300
    assert f"{simhash.fingerprint(long.encode()):016x}" == simhash.brute_force([(1, long)])[0][1]


def files():
    import public_tokenizers as public

    return public.path(queries.BYTE_BPE), public.path(queries.PIECES)


@pytest.mark.parametrize("heavy", [1, 50, 1 << 16])
def test_alignment_against_the_libraries(spark, heavy):
    texts = [t for _, t in CASES] + ["a▁b", "naïve  café\r\n\tend ", "<|endoftext|> </s> <0x0A>", "x" * 300, "日本語 und Ελληνικά", "nul\x00here", prose(200), prose(30) + "\n" + prose(30), " lead", "don't 1234567 ..."]
    rows = [(k, t) for k, t in enumerate(texts * 2)] + [(None, "tail")]
    got = align.align(table(spark, rows), *files(), heavy=heavy)
    order = lambda x: tuple((v is not None, v) for v in x)
    assert sorted(map(tuple, got.collect()), key=order) == sorted(align.brute_force(rows, *files()), key=order)


def test_long_texts_are_cut_where_both_tokenizers_cut():
    long = prose(3000) + " 漢字" * 50 + "  " + prose(500) + "\n x"
    whole, cut = align.Pair(*files(), chunk=1 << 30), align.Pair(*files(), chunk=200)
    assert len(cut.pieces(long)) > 50 and cut.chunk == 200
    for x, y in zip(whole.encode([long, "", None, "a"]), cut.encode([long, "", None, "a"]), strict=True):
        assert (x[0] == y[0]).all() and (x[1] == y[1]).all()
    quick, file = whole.encode_a([" " + long, " it's <|endoftext|>"]), align.Pair._file(files()[0])([" " + long, " it's <|endoftext|>"])
    assert [x.tolist() for x in quick] == file


def merkle_rows(n, r):
    lone = [{"doc_id": 1, "source": "only", "lang": None, "n_chars": None, "text": None}, {"doc_id": None, "source": None, "lang": "", "n_chars": 0, "text": "AbC"}, {"doc_id": None, "source": None, "lang": None, "n_chars": 0, "text": "AbC"}]
    return lone + [{"doc_id": r.randrange(n * 2), "source": r.choice(["hot", "hot", "hot", "É", "z", None]), "lang": r.choice(["en", None]), "n_chars": k, "text": r.choice(["Some TEXT é", "", "lower", None])} for k in range(n)]


@pytest.mark.parametrize(("n", "depth"), [(0, 3), (40, 3), (700, 1), (700, 2), (5000, 3)])
def test_merkle_against_one_tree(spark, n, depth):
    rows = merkle_rows(n, random.Random(n))
    df = spark.createDataFrame([tuple(x.values()) + ("x", 1) for x in rows], "doc_id long, source string, lang string, n_chars long, text string, digest string, pos int")
    order = lambda x: tuple((v is not None, v) for v in x)
    assert sorted(map(tuple, merkle.manifest(df, depth=depth).collect()), key=order) == sorted(merkle.brute_force(rows), key=order)


def test_merkle_statement_and_one_source(spark, tmp_path):
    rows = [x for x in merkle_rows(400, random.Random(6)) if x["doc_id"] is not None]
    for part in (rows, [x for x in rows if x["source"] == "only"], rows[:1] + [x for x in rows if x["source"] == "hot"]):
        df = spark.createDataFrame([tuple(x.values()) for x in part], "doc_id long, source string, lang string, n_chars long, text string")
        got = merkle.manifest(df)
        df.toPandas().astype({"n_chars": "Int64"}).to_parquet(tmp_path / "d.parquet")
        db = duckdb.connect()
        db.execute(f"create view documents as from '{tmp_path}/d.parquet'")
        assert sorted(map(tuple, got.collect())) == sorted(db.sql(f"select {', '.join(got.columns)} from ({merkle.ORACLE})").fetchall())


def test_pipeline_stages_take_empty_tables_nulls_and_repeats(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    ddl = "doc_id long, text string, lang string, source string, n_chars long"
    none = spark.createDataFrame([], ddl)
    odd = spark.createDataFrame([(1, prose(60), None, None, 3), (1, prose(60), "en", "s", None), (None, prose(60), "en", "s", 1), (2, None, None, None, None)], ddl)
    for _, stage in pipeline.STAGES:
        assert stage(spark, none, "").collect() == []
        assert len(stage(spark, odd, "").collect()) <= 4


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    a, b = prose(90), prose(90)
    rows = [(1, a), (2, a + " "), (3, a.replace(" ", "  ")), (4, b), (5, b + " tail"), (6, "12 34 !!"), (7, None), (8, prose(150)), (9, prose(150))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = []
    for name, stage in pipeline.STAGES:
        stage(spark, docs, "").write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    assert kept[0] == {1, 2, 3, 4, 5, 8, 9} and kept[1] == {3, 4, 5, 8, 9} and kept[2] == {3, 4, 8, 9}
    assert kept[3] <= kept[2] and kept[4] == kept[3]
    assert all(r["intact"] and r["n_tokens"] == len(r["ids"]) for r in docs.collect())
