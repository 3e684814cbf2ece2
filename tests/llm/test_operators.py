"""Each operator against brute force or a round trip, and its defined cases."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from gleaner.llm import mixing, neighbours, packing, passages, pii, quality, repair, simhash, tokens, urls, wordpiece

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 997}x" for i in range(30_000))
ODD = [
    (None, "a null id has words", "en", "s1", 19), (1, None, "en", "s1", 0), (2, "", "en", None, 0), (3, LONG, "en", "s2", len(LONG)),
    (4, "same text here", "en", "s1", 14), (4, "same text here", "en", "s1", 14), (5, "same text here", "en", "s1", 14), (6, " \n\t ", "en", "s3", 4),
    (7, "É日本 mixed\u00a0white ½ 'tis", None, "s3", 20),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows, and extra columns that clash with what operators compute."""
    df = spark.createDataFrame(ODD, SCHEMA)
    return df.selectExpr("*", "1 as size", "2 as kept", "'x' as fp", "0 as n_words", "0 as length", "0 as part", "'y' as cleaned", "0 as copies", "1 as _t", "2 as _w", "3 as _source", "4 as _rank", "5 as __t", "6 as `row`", "7 as key")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def words_of(x):
    return (x or "").encode().split()


def test_every_operator_takes_an_empty_table(empty, spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    results = [
        quality.quality(empty), simhash.near_duplicates(empty), mixing.mix(empty), pii.personal_data(empty), packing.packed(empty),
        repair.read_tokens(repair.written_tokens(empty)), wordpiece.token_counts(empty), passages.repeated_passages(empty), neighbours.nearest(none), urls.judge(pages),
    ]
    assert [r.count() for r in results] == [0] * 10


def test_quality(odd):
    got = quality.quality(odd).select("doc_id", "text", "n_words", "word_chars", "n_repeat_words", "n_dup_lines", "kept").collect()
    assert len(got) == len(ODD)
    for r in got:
        words = re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        repeated = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in (i, i + 1, i + 2)} if len(words) < 3000 else set(range(len(words)))
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(words), sum(map(len, words)), len(repeated))
        assert not r["kept"]


def test_quality_removes_lines(spark):
    good = "\n".join(f"Here{i} stands{i} a sentence{i} of words{i} of its own{i}." for i in range(12))
    rows = [(1, good), (2, good + "\nHome | About | Contact\nAll rights reserved."), (3, good + "\n" + "\n".join(f"a{i} ### b{i} $$$ c{i} &&& d{i}" for i in range(60)))]
    got = {r["doc_id"]: r for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["kept"] and got[1]["cleaned"] == good and got[2]["kept"] and got[2]["cleaned"] == good and not got[3]["kept"]


def classes_by_force(fps, ids):
    root = {x: x for x in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in zip(ids, fps):
        for j, b in zip(ids, fps):
            if (a ^ b).bit_count() <= 2 and find(i) != find(j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {i: find(i) for i in ids}


def slow_fingerprint(text):
    words = [w.decode() for w in (text or "").encode().lower().split()]
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(docs, odd):
    rows = docs.select("doc_id", "text").collect()
    fps = [slow_fingerprint(r["text"]) for r in rows]
    want = classes_by_force(fps, [r["doc_id"] for r in rows])
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    assert {d: r["component_id"] for d, r in got.items()} == want
    assert [got[r["doc_id"]]["fp"] % (1 << 64) for r in rows] == fps
    few = [(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(odd).collect()]
    assert sorted(few, key=str) == sorted([(None, None), (1, 1), (2, 1), (6, 1), (3, 3), (4, 4), (4, 4), (5, 4), (7, 7)], key=str)


@pytest.mark.parametrize("max_bucket", [2048, 3])
def test_simhash_links_reach_what_all_pairs_reach(spark, max_bucket):
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for x in list(fps)[:20]:
        for _ in range(12):
            fps.add(x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    signed = [x - (1 << 64) if x >> 63 else x for x in sorted(fps)]
    links = simhash.near_links(spark.createDataFrame([(x,) for x in signed], "fp long"), max_bucket=max_bucket).collect()
    assert all(((a ^ b) % (1 << 64)).bit_count() <= 2 for a, b in links)
    root = {x: x for x in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[max(find(a), find(b))] = min(find(a), find(b))
    assert {x: find(x) for x in signed} == classes_by_force([x % (1 << 64) for x in signed], signed)


def test_thresholds_cover(spark):
    both = np.full((64, 64), 250.0) + np.eye(64) * 250
    for n in (100, 10**6, 10**9):
        chosen = simhash.plan(n, both, 2)
        assert sum(t + 1 for _, t in chosen) == 3 and len({b for p, _ in chosen for b in p}) == sum(len(p) for p, _ in chosen)


def test_mixing(docs, odd):
    rows = mixing.mix(docs).collect()
    assert rows == mixing.mix(docs).collect() or sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs).collect()))
    total = sum(r["size"] for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
        assert r["size"] == len(words_of(r["text"])) and r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
    targets = {s: x[0]["target"] for s, x in by.items()}
    assert sum(targets.values()) == pytest.approx(total)
    for s, x in by.items():
        size, largest = sum(r["size"] for r in x), max(r["size"] for r in x)
        assert x[0]["source_size"] == size and targets[s] <= 3 * size + 1e-6
        assert abs(sum(r["taken"] for r in x) - targets[s]) <= 3 * largest
    assert mixing.mix(odd).count() == len(ODD)


def test_targets_stop_at_three_times(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 10), ("c", 1000), (None, 20)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(sizes).collect()}
    assert got["a"] == pytest.approx(30) and got["b"] == pytest.approx(30) and got[None] == pytest.approx(60) and got["c"] == pytest.approx(1040 - 120)


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def slow_base(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            luhn = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits[::-1])) % 10 == 0
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 13 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, *m.span()))
    return out


def test_pii(docs, odd, spark):
    assert pii.base_spans("1.2.3.4.5.6.7.8 x 4465758382889437 a@b.c +1 (743) 555-3824 999.1.1.1 1..2 4 4") == slow_base("1.2.3.4.5.6.7.8 x 4465758382889437 a@b.c +1 (743) 555-3824 999.1.1.1 1..2 4 4")
    rng = random.Random(3)
    for _ in range(2000):
        x = "".join(rng.choice("0123456789.+ -()@ab") for _ in range(60))
        assert pii.base_spans(x) == slow_base(x), x
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    extra = 0
    for r in pii.personal_data(docs).collect():
        base = [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["base"]]
        assert base == slow_base(rows[r["doc_id"]])
        extra += sum(s["kind"] == "secret" for s in r["spans"])
    assert extra == sum(len(re.findall(r'token = "[0-9a-f]{40}"', x)) for x in rows.values())
    assert pii.personal_data(odd).count() == len(ODD)
    clean = pii.stage(spark, docs, "").collect()
    assert len(clean) == len(rows) and {r["doc_id"] for r in clean} == set(rows)
    assert not any(k == "email" for r in clean for k, *_ in slow_base(r["text"]))


def test_secrets_after_equals_signs_and_long_ones():
    for token in ("abcd1234efgh5678ijkl9012", "a1B2" * 75, "a1B2" * 75 + "=="):
        for x in (f"api_key={token}", f"key = {token} end", f'"{token}"'):
            at = x.index(token)
            assert [c[:3] for c in pii.candidates(x) if c[0] == "secret"] == [("secret", at, at + len(token))]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_is_the_tokenizer(name, docs):
    e = tokens.Encoder(tokens.vocabulary(name), most=500)
    texts = [r["text"] for r in docs.limit(60).collect()] + [x[1] for x in ODD if x[1]] + ["It's  we'll\n\n x ", "", " ", "a\tb", "x<|endoftext|>", "..'s '"]
    want = [np.array(x.ids, "<u4").tobytes() for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert e.encode(texts) == want and e.encode([None]) == [b""]


def test_packing(docs, odd):
    for df, capacity in ((docs, 4096), (odd, 64)):
        rows = packing.packed(df, capacity=capacity).collect()
        assert sum(r["piece"] == 0 for r in rows) == df.count()
        room = {}
        for r in rows:
            assert 1 <= r["length"] <= capacity and r["length"] * 4 == len(r["ids"]) and zlib.crc32(r["ids"]) == r["ids_crc32"]
            room.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for parts in room.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= capacity
        least = -(-sum(r["length"] for r in rows) // capacity)
        assert len(room) <= least * 1.05 + 1
    joined = packing.sequences(packing.packed(odd, capacity=64)).collect()
    assert sum(len(r["ids"]) for r in joined) == 4 * sum(r["length"] for r in rows)


def test_exact_complements_come_first():
    counts = np.zeros(11, int)
    for length, n in ((7, 2), (3, 1), (2, 1), (1, 1), (6, 1), (4, 1)):
        counts[length] = n
    out = packing.pack_counts(counts, 10)
    assert all(sum(x * k for x, k in p) == 10 for p, _ in out) and sum(n for _, n in out) == 3


def test_token_files(odd, docs):
    e = tokens.encoder(tokens.vocabulary("byte_bpe_50k.json"))
    for df in (odd, docs):
        want = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or ""), e.encode([r["text"]])[0] + b"\2\0\0\0") for r in df.collect())
        got = sorted(repair.read_tokens(repair.written_tokens(df, shard_tokens=2000)).collect(), key=lambda r: r["start"])
        assert [r["ids"] for r in got] == [bytes(w[1]) for w in want]
        assert [r["start"] for r in got] == [sum(len(w[1]) // 4 for w in want[:i]) for i in range(len(want))]
        assert all(r["ids_crc32"] == zlib.crc32(r["ids"]) and r["n_tokens"] * 4 == len(r["ids"]) for r in got)


def test_grammar_round_trip():
    rng = np.random.default_rng(1)
    texts = [rng.integers(0, 5, int(n)).astype("<u4").tobytes() for n in rng.integers(1, 400, 80)] + [np.full(999, 7, "<u4").tobytes()]
    block = repair.Block(repair.write_block([None, *range(len(texts) - 1)], texts))
    assert len(block.rules) > 5 and len(block.symbols) < block.n_tokens / 2 and block.doc_ids[:2] == [None, 0]
    assert block.all_tokens().tobytes() == b"".join(texts)
    for k, x in enumerate(texts):
        assert block.tokens(k).tobytes() == x and block.tokens(k, 3, 9).tobytes() == x[12:36]


def test_urls():
    assert urls.host_and_path("http://A.Example.COM:80/en/7?x=/a#b") == ("a.example.com:80", "/en/7")
    assert urls.host_and_path(None) == urls.host_and_path("no url") == ("", "") and urls.host_and_path("x://h#f/g") == ("h", "")
    assert urls.rule_of("www.example.com", "/en/71") == ("allow", "example.com/en/7") and urls.rule_of("a.com", "/en/") == ("block", "com/en/")
    assert urls.rule_of("notexample.net", "/de/8") == ("allow", "net/de/") and urls.rule_of("com", "/EN/") is None
    assert urls.hits("http://xxx.com/casinos/free-bet") == (["xxx"], ["bet", "free"])


def test_many_rules_and_listed_terms(spark, tmp_path):
    rng = random.Random(1)
    hosts = [f"h{i}.example" for i in range(300)] + ["example", "a.h7.example"]
    rules = sorted({(rng.choice(["allow", "block"]), f"{rng.choice(hosts)}/{'/'.join(rng.choice('abc') for _ in range(rng.randint(0, 9)))}") for _ in range(100_000)})
    index = urls.Rules(rules)
    for _ in range(40):
        host, path = rng.choice(["", "www.", "x.y."]) + rng.choice(hosts), "/" + "/".join(rng.choice("abc") for _ in range(rng.randint(0, 12)))
        fits = [(-len(r), r, v) for v, r in rules if (host == r.partition("/")[0] or host.endswith("." + r.partition("/")[0])) and path.startswith("/" + r.partition("/")[2])]
        assert index.best(host, path) == (min(fits)[:0:-1] if fits else None)
    spark.createDataFrame([("block", "bad.org/x"), ("allow", "org/")], "verdict string, rule string").write.parquet(str(tmp_path / "rules"))
    (tmp_path / "terms.txt").write_text("gamble\n\n spam \n")
    found, terms = urls.listed(spark, str(tmp_path / "rules"), ("verdict", "rule")), urls.listed(spark, str(tmp_path / "terms.txt"), ("value",))
    assert set(found) == {("block", "bad.org/x"), ("allow", "org/")} and terms == ("gamble", "spam")
    pages = spark.createDataFrame([(1, "http://bad.org/x1"), (2, "http://ok.org/spam"), (3, "http://c.fr/spam"), (4, "http://c.fr/")], "page_id long, url string")
    assert [r["verdict"] for r in urls.judge(pages, found, terms).orderBy("page_id").collect()] == ["block", "allow", "block", "allow"]
    with pytest.raises(ValueError):
        urls.listed(spark, str(tmp_path / "terms.txt"), ("value",), most=1)


def test_mixing_is_a_walk_over_prefix_sums(docs):
    """The copies of each source against a plain walk in the stated order."""
    by = {}
    for r in mixing.mix(docs.select("doc_id", "text", "source")).collect():
        by.setdefault(r["source"], []).append(r)
    first = {}
    for source, rows in by.items():
        rate = rows[0]["target"] / rows[0]["source_size"] if rows[0]["source_size"] else 0
        total = sum(r["copies"] for r in rows)
        n = sum(r["size"] > 0 for r in rows)
        assert abs(total - rate * len(rows)) <= 1 + 3 * (len(rows) - n) and all(int(rate) <= r["copies"] <= int(rate) + 1 for r in rows if r["size"])
        sizes = sorted(r["size"] for r in rows)
        for q in (0.25, 0.5, 0.75):  # every prefix in order of size gets its share
            upto = [r for r in rows if r["size"] <= sizes[int(q * len(sizes))]]
            words = sum(r["size"] for r in upto)
            assert abs(sum(r["taken"] for r in upto) - rate * words) <= 0.1 * rate * words + 2 * max(r["size"] for r in upto)
        first[source] = total
    again = mixing.mix(docs.select("doc_id", "text", "source").repartition(3, "text")).collect()
    assert first == {s: sum(r["copies"] for r in again if r["source"] == s) for s in by}


def test_pipeline_stages_on_odd_rows(odd, empty, spark):
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0
        got = stage(spark, odd, "")
        if name != "best_fit_packing":
            assert got.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        n = got.count()
        assert n == {"quality_rules": 0, "simhash_near_dedup": 5, "pii": len(ODD)}.get(name, n)
        if name == "mixing":
            assert all(r["text"] for r in got.collect())
        if name == "best_fit_packing":
            assert sum(r["piece"] == 0 for r in got.collect()) == len(ODD)


def test_odd_rows_of_vectors_pages_and_passages(odd, spark):
    assert passages.repeated_passages(odd).count() == 0
    pages = spark.createDataFrame([(1, "http://a.fr/xxx", "h", 1)], "page_id long, url string, host string, verdict int")
    assert [tuple(r)[:5] for r in urls.judge(pages).collect()] == [(1, "a.fr", "/xxx", None, "block")]
    rows = spark.createDataFrame([(i, [float(i), 1.0], "x", 1.0) for i in range(5)], "vec_id long, embedding array<double>, key string, score double")
    assert [r["vec_id"] for r in neighbours.nearest(rows, k=2).orderBy("rank").collect()] == [1, 2]  # all at 1: ties go to smaller ids


def test_probes_of_several_hashes(spark):
    lsh = neighbours.CrossPolytope(20, tables=3, hashes=2, seed=1)
    x = np.random.default_rng(5).normal(size=(6, 20))
    c = lsh.closeness(x)
    for r in range(6):
        for t in range(3):
            both = c[r, t, 0][:, None] + c[r, t, 1][None, :]
            got = lsh.order(x, 50)[r, t]
            assert len(set(got.tolist())) == 50
            assert np.allclose(both.ravel()[got], np.sort(both.ravel())[::-1][:50])
    assert neighbours.CrossPolytope(64, tables=8, hashes=4).order(np.ones((40, 64)), 300).shape == (40, 8, 300)


def test_url_verdicts(spark):
    rows = [(1, "http://a.fr/poker/bonus"), (2, "http://a.fr/poker/poker"), (3, None), (None, "http://a.fr/xxx"), (5, "http://b.com/en/1")]
    got = {r["page_id"]: r["verdict"] for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got == {1: "block", 2: "allow", 3: "allow", None: "block", 5: "block"}


def greedy(pieces, word):
    symbols, n = (*word, wordpiece.END), 0
    while symbols:
        cut = next((k for k in range(len(symbols), 0, -1) if symbols[:k] in pieces), 0)
        if not cut:
            return 1
        symbols, n = symbols[cut:], n + 1
    return n


def test_longest_match(docs, odd):
    rng, end = random.Random(2), wordpiece.END
    pieces = {tuple(rng.choice(b"abc") for _ in range(rng.randint(1, 5))) for _ in range(60)} | {(c,) for c in b"ab"} | {(end,), (97, end), (98, 99, end)}
    m = wordpiece.LongestMatch(pieces)
    for _ in range(3000):
        w = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 14)))
        assert m.count(w) == greedy(pieces, w), w
    path = tokens.vocabulary("word_bpe_49k.json")
    vocab = set(wordpiece.pieces_of(path))
    text = {r["doc_id"]: r["text"] for r in docs.limit(20).collect()}
    for r in wordpiece.token_counts(docs.limit(20)).collect():
        assert r["n_tokens"] == sum(greedy(vocab, w) for w in wordpiece.words_of(text[r["doc_id"]]))
    assert wordpiece.token_counts(odd).count() == len(ODD)


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 20)).astype("f4")
    x[400:500] = x[7]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 20), (1002, [float("nan")] * 20), (1003, [None] * 20), (1004, [1.0]), (5, x[5].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for options in ({}, {"hashes": 2, "recall": 0.99}, {"block_rows": 20}):
        got = {}
        for r in neighbours.nearest(df, k=10, **options).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert set(got) == set(range(0, 600, 20))
        y = x.astype(float)
        found = 0
        for q, near in got.items():
            score = (y * y[q]).sum(1)
            order = [i for i in np.lexsort((np.arange(600), -score)) if i != q][:10]
            found += len(set(order) & {i for i, _ in near})
            assert near == sorted(near, key=lambda p: (-p[1], p[0])) and all(s == pytest.approx(score[i], abs=1e-12) for i, s in near)
        assert found >= 0.9 * 10 * len(got)


def test_compact_windows():
    x = np.random.default_rng(4).integers(0, 50, 80).astype(np.uint64)
    windows = passages.compact_windows(x, 10)
    for i in range(80):
        for j in range(i + 9, 80):
            (hit,) = [w for w in windows if w[0] <= i <= w[1] <= j <= w[2]]
            assert hit[1] == i + int(x[i : j + 1].argmin())


def test_passages(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    text = lambda n: [word() for _ in range(n)]
    shared, long = text(55), text(120)
    edited = list(long)
    edited[60] = "changed"
    rows = [(1, text(200) + shared + text(90)), (2, text(30) + shared + text(10)), (3, text(300)), (4, long), (5, text(20) + edited), (6, text(40)), (7, text(60) + shared[:45]), (8, text(500))]
    rows = [(i, " ".join(w)) for i, w in rows] + [(9, None), (10, ""), (None, " ".join(long)), (11, " ".join(long))]
    got = {r["doc_id"]: r for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {d: r["class_id"] for d, r in got.items()} == {1: 1, 2: 1, 4: 4, 5: 4, 11: 4, None: 4}
    assert got[1]["spans"] == "200:255" and got[2]["spans"] == "30:85" and got[11]["spans"] == "0:120" and got[5]["spans"] == "20:140"


def texts_of(seed, n):
    rng = np.random.default_rng(seed)
    return lambda n=n: [f"{w:06x}".encode() for w in rng.integers(0, 1 << 24, n)]


@pytest.mark.parametrize("n", [50, 55, 60])
def test_a_replaced_word_leaves_a_signature(n):
    text = texts_of(n, n)
    for _ in range(50):
        x = text()
        y = [*x[: n // 2], b"other", *x[n // 2 + 1 :]]
        a, b = (passages.Text(text(40) + z + text(40), 50, 0.8) for z in (x, y))
        assert np.intersect1d(*(passages.signatures(z.words, 50, 0.8)[0] for z in (a, b))).size


def test_a_passage_of_the_least_length_with_a_replaced_word():
    text = texts_of(13, 50)
    for _ in range(20):
        x = text()
        y = [*x[:25], b"other", *x[26:]]
        a, b = (passages.Text(text(40) + z + text(40), 50, 0.8) for z in (x, y))
        keys = np.intersect1d(*(passages.signatures(z.words, 50, 0.8)[0] for z in (a, b))).view(np.int64).tolist()
        assert passages.common_passages(a, b, keys, 0.8)[0] == [(40, 90, 40, 90)]


def test_variety_and_leaders():
    rng = np.random.default_rng(14)
    for n in (1, 2, 30, 100):
        x = rng.integers(0, 8, n).astype(np.uint64)
        for width in (1, 3, 45):
            assert passages._variety(x, width).tolist() == [len(set(x[i : i + width].tolist())) for i in range(n)]
    for _ in range(300):
        n = int(rng.integers(0, 14))
        keys, cuts = np.sort(rng.integers(0, int(rng.integers(1, 8)), n)), np.sort(rng.integers(0, n + 1, 3))
        batches = [pa.RecordBatch.from_pydict({"key": keys[i:j], "row": np.arange(i, j)}) for i, j in zip([0, *cuts], [*cuts, n])]
        got = [tuple(r.values()) for b in passages._led(batches) for r in b.to_pylist()]
        assert got == [(k, i, int(np.argmax(keys == k))) for i, k in enumerate(keys.tolist()) if (keys == k).sum() > 1]


def context_at(text, k):
    return text.contexts[[k]].view(np.int64).tolist()


def test_passages_over_inserted_words_and_before_heavy_edits():
    text = texts_of(1, 70)
    for n in (70, 98):
        x = text(n)
        a, b = passages.Text(x, 50, 0.8), passages.Text([*x[: n // 2], b"other", *x[n // 2 :]], 50, 0.8)
        assert passages.common_passages(a, b, context_at(a, 3), 0.8)[0] == [(0, n, 0, n + 1)]
    x = text(200)
    y = [b"other%d" % i if i == 45 or i > 90 and i % 7 == 0 else w for i, w in enumerate(x)]
    a, b = passages.Text(x, 50, 0.8), passages.Text(y, 50, 0.8)
    ((s, e, _, _),), _ = passages.common_passages(a, b, context_at(a, 3), 0.8)
    assert s == 0 and e >= 91


def test_passages_whose_leader_holds_a_part(spark):
    text = texts_of(2, 52)
    rows = []
    for k in range(0, 60, 3):
        x = text()
        rows += [(k, text(60) + x[:49] + text(9)), (k + 1, text(30) + x), (k + 2, x + text(80))]
    df = spark.createDataFrame([(d, b" ".join(w).decode()) for d, w in rows], "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in passages.repeated_passages(df).collect()}
    assert got == {k + i: k + 1 for k in range(0, 60, 3) for i in (1, 2)}


def test_rows_that_repeat_a_doc_id(spark):
    text = texts_of(8, 60)
    a, b, c = (b" ".join(text()).decode() for _ in range(3))
    rows = [(1, a), (1, b), (2, b), (3, c), (3, c), (None, None), (4, " ".join(f"w{i}" for i in range(40_000)) + " " + b)]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["class_id"], r["spans"]) for r in got) == [(1, 1, "0:60"), (2, 1, "0:60"), (3, 3, "0:60"), (3, 3, "0:60"), (4, 1, "40000:40060")]


def classes_of(links, ids):
    root = {x: x for x in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return {x: find(x) for x in ids}


def test_equal_passages_are_never_lost(spark):
    """All texts hold a random part of their group's passage: what shares 50 words is one class, whoever leads."""
    rng, text, rows = random.Random(4), texts_of(5, 70), []
    for _ in range(40):
        x = text()
        for _ in range(rng.randint(3, 9)):
            a = rng.randint(0, 35)
            rows.append(text(rng.randint(5, 60)) + x[a : a + rng.randint(20, 70)] + text(rng.randint(5, 60)))
    by = {}
    for d, w in enumerate(rows):
        for i in range(len(w) - 49):
            by.setdefault(tuple(w[i : i + 50]), []).append(d)
    links = [(ds[0], d) for ds in by.values() for d in ds[1:]]
    linked = {d for link in links for d in link}
    want = {d: c for d, c in classes_of(links, range(len(rows))).items() if d in linked}
    df = spark.createDataFrame([(d, b" ".join(w).decode()) for d, w in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in passages.repeated_passages(df).collect()}
    assert {d: r["class_id"] for d, r in got.items()} == want
    for d, w in enumerate(rows):  # and their spans are all the stretches that another text has
        covered = {j for i in range(len(w) - 49) if len(set(by[tuple(w[i : i + 50])])) > 1 for j in range(i, i + 50)}
        spans = [tuple(map(int, s.split(":"))) for s in got[d]["spans"].split(",")] if d in got else []
        assert {j for a, b in spans for j in range(a, b)} == covered


def edited(rng, words, n):
    for _ in range(n):
        k = rng.randrange(5, len(words) - 5)
        words = [words[:k] + [b"new%d" % rng.randrange(10**6)] + words[k + 1 :], words[:k] + [b"more%d" % rng.randrange(10**6)] + words[k:], words[:k] + words[k + 1 :]][rng.randrange(3)]
    return words


def test_edited_passages_behind_shorter_ones(spark):
    """Two edited copies of a passage, and texts of smaller ids that hold parts too short to be passages."""
    rng, text, rows, pairs = random.Random(6), texts_of(7, 60), [], []
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    while len(pairs) < 100:
        x = text(rng.randint(60, 130))
        two = edited(rng, x, len(x) // 60), edited(rng, x, rng.randint(0, 1))
        if len(grams(two[0]) & grams(two[1])) < 0.8 * len(grams(two[0]) | grams(two[1])):
            continue
        for _ in range(rng.randint(0, 3)):
            a = rng.randrange(len(x) - 30)
            rows.append(text(40) + x[a : a + rng.randint(25, 48)] + text(40))
        pairs.append((len(rows), len(rows) + 1))
        rows += [text(rng.randint(0, 40)) + w + text(rng.randint(0, 40)) for w in two]
    df = spark.createDataFrame([(d, b" ".join(w).decode()) for d, w in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in passages.repeated_passages(df).collect()}
    found = sum(got.get(a) is not None and got.get(a) == got.get(b) for a, b in pairs)
    print("edited passages found:", found, "of", len(pairs))
    assert found >= 95


def test_edited_passages_behind_many_leaders(spark):
    """Two copies of every pair of halves, with another word between them: each half, too short to be a passage, has texts of
    six classes, and nothing but the halves is in common."""
    text = texts_of(11, 30)
    first, second = ([text() for _ in range(6)] for _ in range(2))
    rows = [(i, j, text(25) + x + text(1) + y + text(25)) for i, x in enumerate(first) for j, y in enumerate(second) for _ in range(2)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(d, b" ".join(w).decode()) for d, (_, _, w) in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in passages.repeated_passages(df).collect()}
    least = {}
    for d, (i, j, _) in enumerate(rows):
        least.setdefault((i, j), d)
    assert got == {d: least[i, j] for d, (i, j, _) in enumerate(rows)}


def test_surroundings_are_one_row_a_place(spark, monkeypatch):
    """Texts that share a line of 30 words, each between others: no step makes a row for each shingle around it."""
    text, made = texts_of(12, 30), []
    line = text()
    rows = [(d, b" ".join(text(90) + line + text(90)).decode()) for d in range(40)]

    def counted(*args, f=passages.map_rows, **kw):
        out = f(*args, **kw)
        made.append(out.count())
        return out

    monkeypatch.setattr(passages, "map_rows", counted)
    assert not passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert max(made) <= 100 * len(rows)


def test_what_a_text_repeats_is_read_once(spark, monkeypatch):
    """Texts that repeat a line of 30 words, which all have, and one of their own: rows go by what is different in a text."""
    text, made = texts_of(15, 30), []
    line = text()
    rows = [(d, b" ".join((line + text(25)) * 20).decode()) for d in range(20)]

    def counted(*args, f=passages.map_rows, **kw):
        out = f(*args, **kw)
        made.append(out.count())
        return out

    def last_step(*args, f=passages._apart):
        made.clear()
        monkeypatch.setattr(passages, "map_rows", counted)
        return f(*args)

    monkeypatch.setattr(passages, "_apart", last_step)
    assert not passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert max(made[:2]) <= 100 * len(rows)


def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "pii", "mixing", "best_fit_packing"]
    root = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{root}/documents.parquet")
    kept = corpus_pipeline.STAGES[0][1](spark, docs, root)
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in quality.quality(docs).where("kept").collect()}
    single = corpus_pipeline.STAGES[1][1](spark, kept, root)
    found = simhash.near_duplicates(kept).where("doc_id = component_id")
    assert single.columns == docs.columns and {r["doc_id"] for r in single.collect()} == {r["doc_id"] for r in found.collect()}
    assert corpus_pipeline.run(spark, root).agg(F.max("length")).first()[0] <= 4096
