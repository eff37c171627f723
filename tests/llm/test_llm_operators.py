"""Operators of the llm subpackage against plain models, and on odd rows: nulls, empty and long texts, ties,
repeated rows, empty tables and further columns."""

from __future__ import annotations

import base64
import hashlib
import random
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from rowtide.llm import bwt_dedup, byte_bpe, components, decontaminate, imatch, kernels, language, passages, quality, seeds, simhash, storage, token_files, url_templates

SCHEMA = "doc_id long, text string, row long, spans string, fp string, key string"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """(doc_id, text) with copies, near copies, shared passages, repeats inside, odd spaces, nulls and a long text."""
    rng = random.Random(11)
    texts = [words(rng, rng.randrange(1, 120)) for _ in range(60)]
    passage, line = words(rng, 45), words(rng, 22)
    for i in range(0, 60, 4):
        cut = rng.randrange(1, 10)
        texts[i] = " ".join([*texts[i].split()[:cut], passage if i % 8 else line, *texts[i].split()[cut:]])
    near = texts[5].split()
    texts += [texts[3], texts[3], " ".join(["other", *near[1:]]), texts[7] + "  " + texts[7], "\t".join(texts[9].split()) + "\n", words(rng, 15_000, 50_000) + " " + passage]
    texts += [None, "", "   \n", "x", "é ü ß", "a" * 5000, "ab " * 300, "!" * 130, None, texts[10].upper(), "x\x1cy z\u00a0 w"]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return sorted(zip(ids, texts))


@pytest.fixture
def docs(spark, corpus):
    rows = [(i, t, -i, "s", "f", "k") for i, t in corpus]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def data(text):
    return b"" if text is None else text.encode()


# -- 1 -------------------------------------------------------------------------------------------------------


def url_model(url):
    at = -1 if url is None else url.find("://")
    if at < 0:
        return "", "", None
    rest = url[at + 3 :]
    end = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:].split("?")[0].split("#")[0] if rest[end : end + 1] == "/" else ""
    best = None
    for verdict, rule in url_templates.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return host, path, best


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://Foo.COM/en/x?q=/a#b", "x://example.com/en/7a", "a://example.com?x", "b://net/de/1", "c://a.example.net/de/8", "d://xnet/de/", "e://org", "f://É.org/es/1", "g://a.org/es/#x", "h://a.org/es", "http://com/en/http://net/de/"] * 2
    got = url_templates.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit(1)))
    assert got.count() == len(urls)
    for r in got.collect():
        host, path, best = url_model(urls[r["page_id"]])
        assert (r["host"], r["path"]) == (host, path)
        assert (r["rule"], r["verdict"]) == (best if best else (None, "allow"))
    assert url_templates.filter_urls(spark.createDataFrame([], "page_id long, url string")).collect() == []


def test_url_templates_learn(spark):
    urls = [f"http://h{h}.com/{'ad' if i % 2 else 'news'}/{i}/{slug}" for h in range(2) for i in range(40) for slug in ("a", "b")]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = [("block", "h0.com/ad/1"), ("allow", "h0.com/news/2"), ("block", "h1.com/ad/3")]
    got = {r["page_id"]: r for r in url_templates.filter_urls(pages, rules).collect()}
    assert {r["template"] for i, r in got.items() if "h0.com/ad" in urls[i]} == {"/ad/{n}/*"}  # alike in their labels
    assert {r["template"] for i, r in got.items() if "h1.com/news" in urls[i]} == {"/news/{n}/a", "/news/{n}/b"}  # no labels
    for i, url in enumerate(urls):
        assert got[i]["verdict"] == ("block" if "/ad/" in url else "allow"), url
    assert {r["rule"] for i, r in got.items() if "/ad/" in urls[i]} == {"h0.com/ad/1", "h1.com/ad/3", None}
    many = spark.createDataFrame([(i, f"http://x.y/p/{chr(97 + i % 26)}{chr(97 + i // 26)}/q") for i in range(200)], "page_id long, url string")
    assert {r["template"] for r in url_templates.filter_urls(many, ()).collect()} == {"/p/*/q"}


@pytest.mark.parametrize("sections", [20, 60, 200])
def test_url_sections_do_not_spoil_each_other(spark, sections):
    """However many sections a host has, those without a rule are not blocked for the one that has."""
    urls = [f"http://a.com/{'en' if s == 0 else 'x' + chr(97 + s // 26) + chr(97 + s % 26)}/{chr(97 + k)}" for s in range(sections) for k in range(8)]
    got = url_templates.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"))
    assert {(r["path"].split("/")[1] == "en", r["verdict"]) for r in got.collect()} == {(True, "block"), (False, "allow")}


# -- 2 -------------------------------------------------------------------------------------------------------


def print_model(text, n):
    own = data(text).lower().split()
    if not own:
        return 0
    shingles = [b" ".join(own[i : i + n]) for i in range(max(1, len(own) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(ids, linked):
    least = {i: i for i in ids}

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    for i in ids:
        for j in ids:
            if i < j and linked(i, j) and find(i) != find(j):
                a, b = sorted((find(i), find(j)))
                least[b] = a
    return {i: find(i) for i in ids}


def test_simhash(docs, corpus, none):
    prints = {i: print_model(t, 3) for i, t in corpus}
    want = groups(list(prints), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 2)
    got = simhash.near_duplicates(docs, words=3, distance=2).select("doc_id", simhash.hex64(F.col("fp")).alias("h"), "component_id").collect()
    assert {r["doc_id"]: (r["h"], r["component_id"]) for r in got} == {i: (f"{p:016x}", want[i]) for i, p in prints.items()}
    assert simhash.near_duplicates(none).collect() == []


@pytest.mark.parametrize("hot", [1, 3, 1000])
@pytest.mark.parametrize("distance", [0, 1, 2, 3, 4])
def test_links(spark, distance, hot):
    rng = random.Random(distance)
    base = [rng.getrandbits(64) for _ in range(6)]
    prints = sorted({b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(5))) for b in base for _ in range(25)})
    signed = [p - 2**64 if p >> 63 else p for p in prints]
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= distance}
    got = {(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"), distance, hot).collect()}
    assert got == want


def test_links_broadcast_no_variants(spark):
    prints = spark.range(2000).select(F.xxhash64("id").alias("fp"))
    plan = simhash.links(prints, 2)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_other_pairs_broadcast_no_postings(spark):
    zero = [F.lit(0).cast("long").alias(s) for s in simhash._SKETCHES]
    nodes = spark.range(40).select(F.col("id").alias("node"), F.col("id").alias("grp"), F.lit(5).cast("long").alias("n"), F.array((F.col("id") % 20) * 9).alias("prefix"), *zero)
    pairs = simhash._other_pairs(nodes, 0.8, 300)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert sorted(map(tuple, pairs.collect())) == [(i, i + 20) for i in range(20)]


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(100 + rng.randrange(60), 100 + rng.randrange(60)) for _ in range(50)] + [(500, 500), (0, 1)]
    want = groups(sorted({x for e in edges for x in e}), lambda i, j: (i, j) in edges or (j, i) in edges)
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: c for n, c in want.items() if n != 500}


@pytest.mark.parametrize("hot", [2, 300])
def test_similar_groups(docs, corpus, spark, hot):
    sets = {i: set(kernels.shingle_sets([t], 5)[0].tolist()) for i, t in corpus}
    similar = lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    want = groups(list(sets), similar)
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(docs, hot=hot).collect()}
    assert got == want
    extra = spark.createDataFrame([(None, "no id"), (3, dict(corpus)[3]), (3, dict(corpus)[3])], "doc_id long, text string")
    kept = simhash.deduplicate(docs.select("doc_id", "text").union(extra).withColumn("mark", F.lit("m")), hot=hot).collect()
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == sorted(set(want.values()))
    assert [r["text"] for r in kept if r["doc_id"] is None] == ["no id"] and {r["mark"] for r in kept} == {"m"}


def test_similar_groups_of_texts_with_one_id(spark):
    rng = random.Random(12)
    a, b, c = (words(rng, 40, 10_000) for _ in range(3))
    rows = [(5, a), (1, a + " more"), (5, b), (5, b), (5, b + " end"), (7, c), (7, None), (8, ""), (None, c), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(map(tuple, simhash.deduplicate(df).collect()), key=str)
    own = [r for r in kept if r[0] == 5]
    assert len(own) == 1 and own[0][1] in (b, b + " end")
    assert [r for r in kept if r[0] != 5] == sorted([(1, a + " more"), (7, c), (7, None), (None, c), (None, None)], key=str)
    assert simhash.deduplicate(df.limit(0)).collect() == []


def test_similar_groups_in_a_crowd(spark):
    """A thousand edits of one text, many of them just below the similarity, against all pairs."""
    rng = random.Random(13)
    base = [f"v{rng.randrange(10**9)}" for _ in range(120)]
    rows = []
    for i in range(1000):
        own = list(base)
        for _ in range(rng.randrange(1, 7)):
            own[rng.randrange(len(own))] = f"n{rng.randrange(10**9)}"
        rows.append((i, " ".join(own)))
    sets = np.zeros((len(rows), 0))
    every = [kernels.shingle_sets([t], 5)[0] for _, t in rows]
    values = np.unique(np.concatenate(every))
    sets = np.zeros((len(rows), len(values)), dtype=np.float32)
    for i, s in enumerate(every):
        sets[i, np.searchsorted(values, s)] = 1
    both = sets @ sets.T
    size = sets.sum(1)
    similar = both >= 0.8 * (size[:, None] + size[None, :] - both)
    want = groups(range(len(rows)), lambda i, j: similar[i, j])
    for hot in (20, 300):
        got = simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), hot=hot)
        assert {r["doc_id"]: r["component_id"] for r in got.collect()} == want


def test_similar_groups_miss_no_pair(spark):
    rng = random.Random(5)
    rows = []
    for i in range(600):  # 90 shingles each, 80 of 100 shared
        own = [f"v{rng.randrange(10**9)}" for _ in range(104)]
        rows += [(2 * i, " ".join(own[:94])), (2 * i + 1, " ".join(own[10:]))]
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [i for i in range(600) if got[2 * i] != 2 * i or got[2 * i + 1] != 2 * i] == []


# -- 3 -------------------------------------------------------------------------------------------------------


def test_language(spark, none):
    rng = random.Random(8)
    sounds = {"xx": "ba bo ka lo mi", "yy": "zer tun vök ßel", "zz": "qui ñar lle chó"}
    make = lambda lang: " ".join("".join(rng.choice(sounds[lang].split()) for _ in range(3)) for _ in range(20))
    rows = [(i, make(lang), lang) for i, lang in enumerate(sorted(sounds) * 40)] + [(900, None, "xx"), (901, "12 34!", "xx"), (902, "", None), (904, "½ ² _ 7", "xx"), (903, make("yy"), None), (None, make("zz"), "zz")]
    got = language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("gram", F.lit(1))).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in by if i is not None)
    assert all(by[i]["lang_pred"] == lang for i, t, lang in rows if lang and t and i not in (901, 904))
    assert by[903]["lang_pred"] == "yy" and all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (900, 901, 902, 904))
    assert all(0 <= r["score"] <= 1 for r in got)
    assert language.identify(none.withColumn("lang", F.lit("x"))).collect() == []


def test_language_does_not_depend_on_neighbours():
    model = language.LanguageFilter(["a", "b"], [np.unique(language.trigrams(["abcabd xyz"])[0]), np.unique(language.trigrams(["q r s tuv"])[0])])
    texts = ["abc", "", "xyz q", "b", "tuv abd"]
    assert (model.counts(texts) == np.concatenate([model.counts([t]) for t in texts])).all()


def test_language_against_plain_sets(spark):
    """Masks and counts, trigram by trigram; the filter is large enough here to have next to no chance hits."""
    rng = random.Random(18)
    sounds = {"xx": ["ba", "bo", "ka"], "yy": ["zer", "tun", "vök"], "zz": ["qui", "ñar", "lle"]}
    make = lambda lang: " ".join("".join(rng.choice(sounds[lang]) for _ in range(3)) for _ in range(20))
    rows = [(i, make(lang), lang) for i, lang in enumerate(sorted(sounds) * 20)]
    model = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    grams = lambda text: [f" {text.lower()}  "[i : i + 3] for i in range(len(text))]
    count = {lang: {} for lang in sounds}
    for _, text, lang in rows:
        for g in grams(text):
            count[lang][g] = count[lang].get(g, 0) + 1
    share = {lang: {g: n / sum(c.values()) for g, n in c.items()} for lang, c in count.items()}
    every = {g for c in share.values() for g in c}
    own = {lang: {g for g in every if share[lang].get(g, 0) > 1.5 * sum(c.get(g, 0) for c in share.values()) / 3} for lang in share}
    for text in [make("xx"), make("yy"), make("zz"), "baquizer tun lleka"]:
        want = [sum(g in own[lang] for g in grams(text)) for lang in model.languages]
        got = model.counts([text])[0]
        assert np.abs(got - want).max() <= 3 and got.argmax() == int(np.argmax(want)), text


# -- 4 -------------------------------------------------------------------------------------------------------

RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe(docs, corpus, none, reference):
    ids = byte_bpe.encode(docs.select("doc_id", "text", F.lit(1).alias("ids_offsets")), RANKS, PATTERN, with_offsets=True)
    back = byte_bpe.decode(ids, RANKS, PATTERN).select("*", byte_bpe.decode_text(F.col("decoded")).alias("t")).collect()
    both = {r["doc_id"]: r for r in byte_bpe.encode_decode(docs.select("doc_id", "text"), RANKS, PATTERN).collect()}
    texts = dict(corpus)
    assert len(back) == len(texts)
    for r in back:
        text = texts[r["doc_id"]] or ""
        want, starts = reference.decode_with_offsets(reference.encode_ordinary(text))
        assert np.frombuffer(r["ids"], "<u4").tolist() == reference.encode_ordinary(text)
        assert r["decoded"] == text.encode() and r["t"] == text and want == text
        assert all(a < b for a, b in r["ids_offsets"]) and [a for a, _ in r["ids_offsets"]] == starts
        assert (both[r["doc_id"]]["ids"], both[r["doc_id"]]["decoded"]) == (r["ids"], r["decoded"])
    assert byte_bpe.encode_decode(none, RANKS, PATTERN).collect() == []


def test_byte_bpe_odd_texts(reference):
    tokens = byte_bpe.read_ranks(RANKS)
    bpe = byte_bpe.ByteBPE(tokens, byte_bpe.model_json(tokens, PATTERN))
    rng = random.Random(5)
    parts = ["a", "the", " ", "  ", "\n", "\t", "\x0b", "\u00a0", "\u2003", "é", "É", "'s", "don't", "12", "...", "!!", "漢字", "🙂", "\x1c", "\x00", "\u0301", "-"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(400)]
    bpe.cache.limit = 40
    ids, counts = bpe.encode([t.encode() for t in texts])
    ends = np.cumsum(counts)
    for t, a, b in zip(texts, ends - counts, ends):
        assert ids[a:b].tolist() == reference.encode_ordinary(t)
        assert "".join(bpe.decode_stream(ids[a:b].tolist())) == t


# -- 5 -------------------------------------------------------------------------------------------------------


def test_contamination(spark):
    train = "A train leaves at {} {} per hour, and {} waits {} hours before {} meets {} at the old station near the river."
    items = [(1, train.format(60, "km", "Alice", 3, "Alice", "Bob")), (2, "short one here"), (3, None), (4, ""), (5, "two words"), (1, train.format(60, "km", "Alice", 3, "Alice", "Bob"))]
    docs = [
        (1, "So. " + train.format(75, "miles", "Carol", 5, "Carol", "Dave") + " End."), (2, train.format(75, "km", "Carol", 5, "Erin", "Dave")), (3, None), (4, ""), (5, "here is a short one here"), (6, "A train leaves at the old station."),
        (None, train.format(60, "km", "Alice", 3, "Alice", "Bob")), (7, "x " * 4000 + train.format(1, "mi", "Zoe", 2, "Zoe", "Max")), (7, "again"), (8, train.format(60, "km", "Alice", 3, "Alice", "Bob")[:60]),
    ]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("tokens", F.lit(1)).repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.find_contaminated(d, b).collect()}
    assert set(got) == {(1, 1), (5, 2), (None, 1), (7, 1)}
    assert (got[1, 1]["n_slots"], got[1, 1]["n_changed"]) == (6, 5) and got[None, 1]["n_changed"] == 0
    assert decontaminate.find_contaminated(d, b.limit(0)).collect() == [] and decontaminate.find_contaminated(d.limit(0), b).collect() == []


def test_contamination_by_alignment(spark):
    template = "The {0} boxes on the long wooden table of the old harbour hold {1} balls and {2} small coins, while {0} boxes under it hold {3} pens for the {1} guests."
    item = template.format(12, 7, 45, 9)
    clauses = " ".join(f"The red box on the long table holds {n} balls." for n in (12, 7, 45))
    one, other = template.format(13, 8, 46, 10), template.format(31, 5, 64, 77)
    moved = item.replace("wooden table", "wooden and heavy table")
    docs = [(1, f"{item} {one}"), (2, f"{one} And then again: {other}"), (3, f"{moved} Next. {one}"), (4, clauses), (5, f"Before. {clauses} After."), (6, template.format(1, 2, 3, 4).replace("1 boxes under", "5 boxes under").replace("2 guests", "6 guests")), (7, item), (7, other), (8, "nothing of the kind is in here at all")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(1, item), (2, clauses)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.find_contaminated(d, b).collect()}
    assert set(got) == {(1, 1), (2, 1), (3, 1), (7, 1), (4, 2), (5, 2)}
    assert got[1, 1]["n_changed"] == 0 and got[1, 1]["coverage"] == 1 and got[2, 1]["n_changed"] == 4 and got[4, 2]["n_changed"] == 0


def test_contamination_by_values(spark):
    sums, table, name = "Compute 3 + 4 * 12 - 5 / 7.", "12 13 15 18 22 27 33 40 48 57 67 78", "Zanzibar 1964"
    docs = [(1, f"Exercise: {sums} Then rest."), (2, sums.replace("12", "13")), (3, f"x {table} y"), (4, "it was zanzibar 1964 again"), (5, "Zanzibar 1965"), (6, None), (7, "12 13 15 18 1 2 3 4 5 6 7 8")]
    b = spark.createDataFrame([(1, sums), (2, table), (3, name), (4, "+"), (5, None)], "item_id long, text string")
    got = decontaminate.find_contaminated(spark.createDataFrame(docs, "doc_id long, text string"), b).collect()
    assert sorted((r["doc_id"], r["item_id"], r["coverage"]) for r in got) == [(1, 1, 1.0), (3, 2, 1.0), (4, 3, 1.0)]


def test_contamination_of_made_up_items(spark):
    """Verbatim copies and consistent variants are found; inconsistent ones, those with one value for all, and clean texts are not."""
    rng = random.Random(21)
    names = [f"{a}{b}" for a in ("Al", "Bo", "Cy", "Di", "Ed", "Fi", "Gu", "Ha") for b in ("na", "rto", "lisa", "mund")]
    items, rows, want = [], [], set()
    for i in range(12):
        body = [f"v{i}x{rng.randrange(30)}".translate(str.maketrans("0123456789", "abcdefghij")) for _ in range(70)]
        at = sorted(rng.sample(range(8, 68, 5), 8))
        slots = {p: rng.choice([("n", k) for k in range(3)] + [("m", k) for k in range(3)]) for p in at}
        def say(value, body=body, slots=slots):
            return " ".join(f"{w} {value(slots[k])}" if k in slots else w for k, w in enumerate(body))
        def drawn():
            who, what = rng.sample(names, 3), rng.sample(range(10, 999), 3)
            return lambda s: who[s[1]] if s[0] == "n" else str(what[s[1]])
        item = say(drawn())
        items += [(i, item), (i, item)]
        several = len(set(slots.values())) < len(slots)
        texts = [(item, True), (f"So it is. {say(drawn())} And more.", True), (" ".join(body[::-1]), False), (f"{say(drawn())} {item} {say(drawn())}", True)]
        if several:
            texts.append((say(lambda s: rng.choice(names) if s[0] == "n" else str(rng.randrange(1000, 10**6))), False))
        if len({s for s in slots.values() if s[0] == "n"}) == 3:
            texts.append((say(lambda s: "Olaf" if s[0] == "n" else "7"), False))
        for text, found in texts:
            rows.append((len(rows), text))
            if found:
                want.add((len(rows) - 1, i))
    items.append((None, items[0][1]))
    want |= {(d, None) for d, i in want if i == 0}
    got = decontaminate.find_contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want


def test_contamination_against_all_windows(spark):
    """The documents of the smallest table against its items, window by window."""
    sf = "/root/testdata/sf0.001"
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    own = {r[0]: r[1] for r in docs.select("doc_id", decontaminate.tokens(F.col("text"))).collect()}
    want = set()
    for item, tokens in items.select("item_id", decontaminate.tokens(F.col("text"))).collect():
        assert not set(tokens) & {decontaminate.NUMBER, decontaminate.NAME, decontaminate.UNIT} and len(tokens) >= 3
        width = min(8, len(tokens))
        windows = [tuple(tokens[j : j + width]) for j in range(len(tokens) - width + 1)]
        for doc, text in own.items():
            there = {tuple(text[i : i + width]) for i in range(len(text) - width + 1)}
            if sum(w in there for w in windows) >= 0.5 * len(windows):
                want.add((doc, item))
    got = decontaminate.find_contaminated(docs.withColumn("copy", F.lit("x")).withColumn("item_id", F.lit(1)), items)
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want and want


def test_tokens_keep_their_places(spark, docs):
    odd = spark.createDataFrame([("it cost 5kg, said McDonald to Ann\ue000 on 1.5.2020 at 3 p.m.",), ("Été à Paris, vers Lyon",)], "text string")
    df = docs.select("text").union(odd)
    assert df.where(F.size(decontaminate.tokens(F.col("text"))) != F.size(decontaminate.raw_tokens(F.col("text")))).count() == 0


# -- 6 -------------------------------------------------------------------------------------------------------


def passages_model(corpus, size):
    seen, out = set(), {}
    for i, text in corpus:
        own = data(text).split()
        gone = [False] * len(own)
        for p in range(len(own) - size + 1):
            window = tuple(own[p : p + size])
            if window in seen:
                gone[p : p + size] = [True] * size
            seen.add(window)
        out[i] = (len(own), sum(gone), b" ".join(w for w, g in zip(own, gone) if not g))
    return out


@pytest.mark.parametrize("segment", [None, 64])
def test_passages(docs, corpus, none, segment, monkeypatch):
    if segment:
        monkeypatch.setattr("rowtide.llm.seeds.SEGMENT", segment)
        monkeypatch.setattr("rowtide.llm.passages.CHUNK", 200)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in passages.remove_passages(docs).collect()}
    assert {i: (n, r, bytes(k)) for i, (n, r, k) in got.items()} == passages_model(corpus, 20)
    assert passages.remove_passages(none).collect() == []


def test_strip_passages(docs, corpus):
    want = passages_model(corpus, 20)
    rows = passages.strip_passages(docs).collect()
    assert len(rows) == len(corpus)
    for r in rows:
        text = dict(corpus)[r["doc_id"]]
        assert r["text"] == (want[r["doc_id"]][2].decode() if want[r["doc_id"]][1] else text)
        assert (r["row"], r["spans"], r["fp"], r["key"]) == (-r["doc_id"], "s", "f", "k")


def test_passages_with_shared_ids(spark):
    rng = random.Random(2)
    a, b = words(rng, 30), words(rng, 30)
    rows = [(1, a), (1, a), (1, b + " x"), (2, a + " " + b), (None, a), (None, a)]
    got = passages.remove_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_words"], r["n_removed"]) for r in got)
    assert found == [(-1, 30, 0), (-1, 30, 0), (1, 30, 0), (1, 30, 0), (1, 31, 0), (2, 60, 60)]


# -- 7 -------------------------------------------------------------------------------------------------------


def strings_model(corpus, size):
    seen, out = set(), {}
    for i, text in corpus:
        raw = data(text)
        gone = [False] * len(raw)
        own = [raw[p : p + size] for p in range(len(raw) - size + 1)]
        for p, s in enumerate(own):
            if s in seen:
                gone[p : p + size] = [True] * size
        seen.update(own)
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(raw), sum(gone), runs, bytes(c for c, g in zip(raw, gone) if not g))
    return out


@pytest.mark.parametrize("small", [False, True])
def test_byte_strings(docs, corpus, none, small):
    options = {"collection": 600, "shard": 150} if small else {}
    rows = bwt_dedup.remove_repeats(docs, **options).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in rows} == strings_model(corpus, 50)
    assert bwt_dedup.remove_repeats(none).collect() == []


def test_contexts_take_bounded_memory(spark):
    rng = np.random.default_rng(7)
    n, size, k = 150_000, 50, 20
    packed = seeds.pack(np.arange(n) * 100, np.full(n, 31), 30)
    anchor, doc, begin = np.repeat(np.arange(n // 3), 3), np.arange(n) % 1000, np.arange(n) * (31 + size - 1)
    flat = rng.integers(97, 123, n * (31 + size - 1), dtype=np.uint8)
    flat[begin[1] : begin[2]] = flat[: begin[1]]
    tracemalloc.start()
    first, last = bwt_dedup.alive(anchor, doc, packed, begin, flat, size, k)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 15 * len(flat)
    assert np.flatnonzero(first <= last).tolist() == [0, 1] and (first[:2].tolist(), last[:2].tolist()) == ([0, 0], [30, 30])
    found = seeds.found(spark.createDataFrame([], seeds.SEEDS), False)
    assert "Sort [anchor" in found._jdf.queryExecution().optimizedPlan().toString()


def test_whole_groups():
    rng = random.Random(8)
    for _ in range(200):
        keys = sorted(rng.choices(range(-4, 5), k=rng.randrange(0, 40)))
        cuts = sorted(rng.randrange(len(keys) + 1) for _ in range(rng.randrange(0, 9)))
        batches = [pa.RecordBatch.from_arrays([pa.array(keys[a:b], type=pa.int64())], names=["key"]) for a, b in zip([0, *cuts], [*cuts, len(keys)])]
        lists = [[x for b in whole for x in b.column(0).to_pylist()] for whole in seeds.whole_groups(iter(batches), "key", 40)]
        assert [x for own in lists for x in own] == keys and sum(len(set(own)) for own in lists) == len(set(keys))
        assert all(len(own) <= 5 + max(len(b) for b in batches) + max(map(keys.count, own)) for own in lists)


def test_suffix_order_and_interleave():
    rng = random.Random(6)
    for _ in range(20):
        shards = [["".join(rng.choice("ab") for _ in range(rng.randrange(1, 12))).encode() for _ in range(rng.randrange(1, 6))] for _ in range(rng.randrange(1, 6))]
        strings = [s for shard in shards for s in shard]
        string, offset, group = bwt_dedup.repeated_strings(shards, 3)
        assert sorted(zip(string.tolist(), offset.tolist())) == sorted((i, p) for i, s in enumerate(strings) for p in range(len(s) + 1))
        heads = [strings[i][p : p + 3] for i, p in zip(string, offset)]
        by = {}
        for g, h in zip(group.tolist(), heads):
            by.setdefault(g, []).append(h)
        assert all(len(set(v)) == 1 for v in by.values())
        assert all(len(v) == 1 for v in by.values() if len(v[0]) < 3)
        assert len([v for v in by.values() if len(v[0]) == 3]) == len({h for h in heads if len(h) == 3})


# -- 8 -------------------------------------------------------------------------------------------------------


def test_quality(spark, none):
    rng = random.Random(9)
    good = lambda: ". ".join(words(rng, 12).capitalize() for _ in range(8))
    bad = lambda: " ".join(w.upper() + "!!" for w in words(rng, 60).split())
    rows = [(i, good() if i % 2 else bad()) for i in range(400)] + [(900, None), (901, ""), (None, good())]
    labels = [(i, i % 2) for i in range(0, 400)] + [(5, None), (None, 1), (7, 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("features", F.lit(1)).withColumn("label", F.lit(1))
    got = quality.judge(d, spark.createDataFrame(labels, "doc_id long, quality int"))
    by = {r["doc_id"]: r for r in got.collect()}
    assert len(by) == len(rows)
    assert all(by[i]["predicted"] == i % 2 and by[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(400))
    assert by[900]["score"] == by[901]["score"] and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in by.values())
    assert quality.judge(none, spark.createDataFrame([], "doc_id long, quality int")).collect() == []
    unlabelled = quality.judge(d, spark.createDataFrame([], "doc_id long, quality int")).collect()
    assert {r["score"] for r in unlabelled} == {0.5}


def test_held_out_labels_are_not_read(spark):
    rows = [(i, words(random.Random(i), 30)) for i in range(200)]
    labels = [(i, i % 2) for i in range(200)]
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    scores = [{r["doc_id"]: r["score"] for r in quality.judge(d, spark.createDataFrame(x, "doc_id long, quality int")).collect()} for x in (labels, turned)]
    assert scores[0] == scores[1]


def test_scores_against_tables():
    """A score is the logistic function of the bias and one entry of each table."""
    rng = np.random.default_rng(3)
    x = rng.random((600, 4))
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0.7).astype(float)
    model = quality.AdditiveModel(rounds=20).fit(x, y)
    place = lambda edges, v: sum(bool(e <= v) for e in edges)
    for row, score in zip(x[:50], model.score(x[:50])):
        bins = [place(e, v) for e, v in zip(model.edges, row)]
        total = model.bias + sum(t[b] for t, b in zip(model.tables, bins)) + sum(t[place(gj, bins[j]), place(gk, bins[k])] for j, k, gj, gk, t in model.pairs)
        assert abs(score - 1 / (1 + np.exp(-total))) < 1e-9
    names = dict(zip(quality.FEATURES, quality.features_of(b"One one TWO 22 -- ab.\nOne one TWO")))
    assert np.isclose(names["log_words"], np.log1p(9)) and np.isclose(names["mean_length"], np.mean([3, 3, 3, 2, 2, 3, 3, 3, 3]))
    assert np.isclose(names["capitals"], 2 / 9) and np.isclose(names["bare"], 1 / 9) and np.isclose(names["distinct"], 6 / 9) and np.isclose(names["stops"], 1 / 9)


def test_quality_of_repeated_ids(spark):
    rows = [(1, "good text here."), (1, "BAD!! BAD!!"), (1, "BAD!! BAD!!"), (2, "fine words. so fine"), (None, "x")] * 3
    d = spark.createDataFrame(rows, "doc_id long, text string")
    x = quality.features(d)
    got = quality.fit(x, spark.createDataFrame([(1, 1), (2, 0), (2, 1)], "doc_id long, quality int"))
    assert got.bias == 0.0  # one row an id: labels 1 and 0
    assert quality.judge(d, spark.createDataFrame([(1, 1)], "doc_id long, quality int")).count() == len(rows)


def test_pairs_of_features():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.AdditiveModel().fit(x, y)
    assert ((model.score(x) > 0.5) == y).mean() > 0.9 and (model.pairs[0][:2]) == (1, 0)


# -- 9 -------------------------------------------------------------------------------------------------------


def test_token_files(spark, docs, corpus, none, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    folder = f"file://{tmp_path}/t"
    manifest = token_files.write_tokens(docs, folder, path, end_id=1, parts=4)
    rows = {r["doc_id"]: r for r in token_files.read_tokens(spark, folder).collect()}
    start = 0
    for i, text in corpus:
        want = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        assert (rows[i]["start"], rows[i]["n_tokens"]) == (start, len(want)) and np.frombuffer(rows[i]["ids"], "<u4").tolist() == want
        start += len(want)
    parts = sorted(manifest.collect())
    flat = np.concatenate([np.memmap(tmp_path / f"t/{p['part']:05d}.ids", dtype="<u2", mode="r") for p in parts])
    assert len(flat) == start and sum(p["n_docs"] for p in parts) == len(corpus)
    offsets = np.memmap(tmp_path / f"t/{parts[0]['part']:05d}.offsets", dtype="<i8", mode="r")
    assert len(offsets) == parts[0]["n_docs"] + 1 and offsets[0] == 0 and offsets[-1] == parts[0]["n_tokens"]
    assert not [p for p in (tmp_path / "t").iterdir() if p.name.startswith(".0")]
    token_files.write_tokens(none, f"file://{tmp_path}/none", path, end_id=1)
    assert token_files.read_tokens(spark, f"file://{tmp_path}/none").collect() == []


def test_token_files_with_odd_ids(spark, tmp_path):
    rows = [(None, "b"), (2, "a"), (2, "a"), (2, None), (None, "a")]
    folder = f"file://{tmp_path}/t"
    token_files.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), folder, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    got = sorted((r["start"], r["doc_id"], r["n_tokens"]) for r in token_files.read_tokens(spark, folder).collect())
    assert [d for _, d, _ in got] == [None, None, 2, 2, 2] and sorted(n for _, d, n in got if d == 2) == [1, 2, 2]
    assert [s for s, _, _ in got] == np.cumsum([0] + [n for _, _, n in got])[:-1].tolist()
    nulls = spark.createDataFrame([(None, f"w{i}") for i in range(200)], "doc_id long, text string")
    manifest = token_files.write_tokens(nulls, f"file://{tmp_path}/nulls", public_tokenizers.path("word_bpe_49k.json"), end_id=1, parts=4)
    assert manifest.count() == 4 and manifest.agg(F.sum("n_docs")).first()[0] == 200


def test_token_files_with_added_tokens(spark, tmp_path):
    from tokenizers import Tokenizer

    path, folder = public_tokenizers.path("word_bpe_49k.json"), f"file://{tmp_path}/added"
    rows = [(1, "before"), (2, "hello <|endoftext|> world"), (3, "A<|startoftext|>b, <|ENDOFTEXT|> c"), (4, "after it"), (5, "<|endoftext|>")]
    token_files.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), folder, path, end_id=1)
    got = {r["doc_id"]: np.frombuffer(r["ids"], dtype="<u4").tolist() for r in token_files.read_tokens(spark, folder).collect()}
    tokenizer = Tokenizer.from_file(path)
    assert got == {i: tokenizer.encode(t, add_special_tokens=False).ids + [1] for i, t in rows}
    assert got[2] == [3306, 49407, 1002, 1]


def test_pieces_forget():
    calls = []

    def encode(pieces):
        calls.extend(pieces)
        lengths = np.array([len(p) for p in pieces], dtype=np.int64)
        return np.frombuffer(b"".join(pieces), dtype=np.uint8).astype(np.uint32), lengths

    from rowtide.llm.tokens import PieceCache

    cache = PieceCache(encode, limit=20)
    rng = random.Random(3)
    for _ in range(60):
        own = [bytes(rng.choices(b"abcdef", k=rng.randrange(1, 4))) for _ in range(rng.randrange(1, 90))]
        raw = b" ".join(own)
        start, end = kernels.word_spans(raw)
        ids, lengths = cache.encode_spans(raw, start, end)
        assert bytes(ids.astype(np.uint8)) == b"".join(own) and lengths.tolist() == [len(p) for p in own]
    assert len(calls) > cache.held


# -- 10 ------------------------------------------------------------------------------------------------------


def test_imatch(spark, docs, corpus, none):
    words_ = imatch.lexicon(docs, low=0.02, high=0.6)
    rows = {r["doc_id"]: r for r in imatch.fingerprint_edits(docs, words_).collect()}
    assert len(rows) == len(corpus)
    texts = [t or "" for _, t in corpus]
    for (i, _), text, after in zip(corpus, texts, texts[1:] + texts[:1]):
        edited = text[: len(text) - len(text) // 4] + after[: len(text) // 4]
        assert rows[i]["n_chars"] == len(text) and rows[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert (rows[i]["fingerprint"] == rows[i]["edited_fingerprint"]) == (rows[i]["near_edited"] == 1.0)
        assert 0 <= rows[i]["near_edited"] <= 1 and 0 <= rows[i]["near_next"] <= 1
    same = {}
    for i, text in corpus:
        same.setdefault(text or "", set()).add(rows[i]["fingerprint"])
    assert all(len(v) == 1 for v in same.values())
    assert np.mean([r["near_edited"] for r in rows.values()]) > 2 * np.mean([r["near_next"] for r in rows.values()])
    assert imatch.fingerprint_edits(none, imatch.lexicon(none)).collect() == []


def test_fingerprints_against_plain_sets():
    """Sub-lexicon hashes agree exactly where the terms drawn are the same; likeness is the most likely of a grid."""
    rng = np.random.default_rng(5)
    lexicon = np.unique(kernels.mix64(np.arange(1, 300, dtype=np.uint64)))
    terms = [np.unique(rng.choice(lexicon, n)) for n in (0, 1, 5, 60, 61, 200)]
    terms.append(terms[3][:-2])
    terms.append(np.array([7, 9], dtype=np.uint64))  # none in the lexicon: all count
    values, count = imatch.sub_hashes(terms, lexicon)
    assert count.tolist() == [len(t) for t in terms]
    drawn = [[frozenset(t for t in own.tolist() if int(kernels.mix64(np.array([t], dtype=np.uint64) ^ seed)[0]) <= int(limit)) for seed, limit in zip(imatch._SEEDS, imatch._LIMITS)] for own in terms]
    for i in range(len(terms)):
        for j in range(len(terms)):
            for k in range(len(imatch.SHARES)):
                if drawn[i][k] == drawn[j][k]:
                    assert values[i, k] == values[j, k]
            assert (values[i] == values[j]).all() == (i == j)
    pairs = [(3, 3), (3, 6), (3, 4), (2, 5)]
    got = imatch.likeness(*(np.array([x[p[s]] for p in pairs]) for s in (0, 1) for x in (values, count)))
    for (i, j), near in zip(pairs, got):
        if i == j:
            assert near == 1.0
            continue
        best = None
        for g in imatch.GRID[1:]:
            d = g * (count[i] + count[j])
            score = 0.0
            for k, p in enumerate(imatch.SHARES[1:], 1):
                stay = (1 - p) ** d
                score += np.log(stay) if values[i, k] == values[j, k] else np.log(max(1e-12, 1 - stay))
            if best is None or score > best[0] + 1e-9:
                best = (score, 1 - g)
        assert abs(near - min(best[1], 1 - imatch.GRID[1])) < 1e-9
    assert got[1] > got[3]


def test_imatch_with_many_copies(spark):
    rng = random.Random(4)
    texts = [words(rng, 20, 300) for _ in range(60)]
    rows = [*enumerate(texts), *[(100 + i, texts[0]) for i in range(40)], (200, ""), (201, "never seen")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lexicon = imatch.lexicon(df, low=0.001, high=0.2)
    assert np.isin(imatch.terms_of([data(texts[0])])[0], lexicon).any()
    near = {r["doc_id"]: r["near_next"] for r in imatch.fingerprint_edits(df, lexicon).collect()}
    assert near[100] == 1.0 and near[139] < 1.0 and near[200] < 1.0


@pytest.mark.parametrize("partitions", ["1", "3", "50"])
def test_next_document(spark, partitions):
    rows = [(None, "n" * 8), (5, "five" * 3), (5, "five" * 3), (7, None), (2, "two two "), (9, "")]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = imatch.fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string"), np.zeros(0, dtype=np.uint64)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    order = ["n" * 8, "two two ", "five" * 3, "five" * 3, "", ""]
    want = sorted(hashlib.sha256((t[: len(t) - len(t) // 4] + u[: len(t) // 4]).encode()).hexdigest() for t, u in zip(order, order[1:] + order[:1]))
    assert sorted(r["edited_sha256"] for r in got) == want


def test_frequencies(docs, corpus):
    want: dict[int, int] = {}
    for _, text in corpus:
        for term in imatch.terms_of([data(text)])[0].tolist():
            want[term] = want.get(term, 0) + 1
    got = {r["term"] & (2**64 - 1): r["df"] for r in imatch.document_frequencies(docs).collect()}
    assert got == want
    assert len(want) == len({w for _, t in corpus for w in data(t).lower().split()})


# -- shared --------------------------------------------------------------------------------------------------


def test_sliding_argmin():
    rng = np.random.default_rng(1)
    for n, w in ((1, 1), (5, 3), (40, 7), (40, 8), (40, 40), (3, 4)):
        h = rng.integers(0, 4, n).astype(np.uint64)
        want = [i + int(np.argmin(h[i : i + w])) for i in range(n - w + 1)]
        assert kernels.sliding_argmin(h, w).tolist() == want


def test_shared_folder(spark):
    df = storage.materialize(spark.range(10), "t")
    assert df.count() == 10 and storage.shared_dir(spark).endswith("/rowtide")
