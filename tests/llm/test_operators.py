import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stallkeeper.llm import chat_format, decontam, lang_id, line_dedup, packing, topk_search, toxicity, url_filter, warc

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string"


def rows_of(df):
    return [tuple(r) for r in df.collect()]


# URL filters


def test_rules_take_the_longest_fit_and_subdomains(spark):
    rules = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/", "block")]
    urls = ["http://A.Example.COM/en/71", "http://example.com/en/8", "http://xexample.com/en/7", "https://net/", "https://net", "https://x.net?q", "mail", None, "", "http://comet/en/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    out = {r.page_id: r for r in url_filter.judge_urls(pages, spark.createDataFrame([], "id long, good boolean"), rules).collect()}
    assert [out[k].rule for k in range(10)] == ["example.com/en/7", "com/en/", "com/en/", "net/", None, None, None, None, None, None]
    assert [out[k].verdict for k in range(5)] == ["allow", "block", "block", "block", "allow"]
    assert (out[0].host, out[0].path, out[5].host, out[5].path, out[6].host, out[7].path) == ("a.example.com", "/en/71", "x.net", "", "", "")


URLS = "page_id long, url string"
VOTES = "id long, good boolean"


def test_variable_segments_become_wildcards_and_bad_templates_are_blocked(spark):
    pages = [(k, f"http://h.com/good/{k}") for k in range(40)] + [(100 + k, f"http://h.com/bad/{k}/x") for k in range(40)] + [(200, "http://h.com/a/b/c/d/e"), (201, None), (202, "http://h.com"), (203, "http://h.com/" + "/".join("y" * 40) + "z" * 100_000)]
    pages += [(3, "http://h.com/good/3")]  # repeated
    labels = [(k, True) for k in range(30)] + [(100 + k, False) for k in range(30)] + [(None, True), (5, None)]
    df = spark.createDataFrame(pages, URLS).withColumn("id", F.lit("x")).withColumn("node", F.lit(1)).withColumn("good", F.lit(2))
    found = url_filter.judge_urls(df, spark.createDataFrame(labels, VOTES), []).collect()
    assert len(found) == len(pages)
    out = {r.page_id: r for r in found}
    assert out[3].template == "h.com/good/*" and out[103].template == "h.com/bad/*/*" and out[200].template == out[203].template == "h.com/*/**" and out[202].template == "h.com"
    assert {out[k].verdict for k in range(40)} == {"allow"} and {out[100 + k].verdict for k in range(40)} == {"block"}  # unlabelled pages of a template too


def test_branches_are_judged_by_evidence_at_any_depth_and_size(spark):
    """A bad section far down, with a hundredth of its parent's pages."""
    pages = [(k, f"http://h.com/a/b/c/{'bad' if k % 100 == 0 else 's' + str(k % 9)}/{k}") for k in range(3000)]
    labels = [(k, k % 100 > 0) for k in range(3000) if k % 3 or k % 100 == 0]
    out = {r.page_id: r for r in url_filter.judge_urls(spark.createDataFrame(pages, URLS), spark.createDataFrame(labels, VOTES), []).collect()}
    assert out[100].template == "h.com/*/*/*/bad/*" and {out[k].template for k in (1, 2, 3)} <= {"h.com/*/*/*/*/*", "h.com/*/*/*/*+1/*"}
    assert {r.verdict for r in out.values() if r.page_id % 100 == 0} == {"block"} and {r.verdict for r in out.values() if r.page_id % 100} == {"allow"}


def test_similar_branches_are_merged(spark):
    pages = [(k, f"http://h.com/{'xy'[k % 2]}/{k}") for k in range(60)]
    labels = [(k, k % 3 > 0) for k in range(60)]
    out = url_filter.judge_urls(spark.createDataFrame(pages, URLS), spark.createDataFrame(labels, VOTES), [])
    assert {r.template for r in out.collect()} == {"h.com/*/*"}
    # two bad sections among good ones are one branch, a half-bad one differs from both
    pages = [(k, f"http://h.com/{'abcdefghpqr'[k % 11]}/{k}") for k in range(1100)]
    labels = [(k, k % 11 < 8 or (k % 11 == 8 and k % 2 == 0)) for k in range(1100)]
    out = {r.page_id: r.template for r in url_filter.judge_urls(spark.createDataFrame(pages, URLS), spark.createDataFrame(labels, VOTES), []).collect()}
    assert out[8] == "h.com/p/*" and out[9] == out[10] == "h.com/*-1/*" and out[0].startswith("h.com/*")
    assert url_filter.judge_urls(spark.createDataFrame([], URLS), spark.createDataFrame([], VOTES), []).count() == 0


# Search


def brute_search(docs, queries, k):
    words = {i: [w for w in decontam.words_of(t)] for i, t in docs}
    tf = {i: collections.Counter(w) for i, w in words.items()}
    df = collections.Counter(t for c in tf.values() for t in c)
    mean = sum(map(len, words.values())) / len(words)
    out = []
    for q, text in queries:
        scored = []
        for i, c in tf.items():
            both = sorted(set(decontam.words_of(text)) & set(c))
            if both:
                s = sum(np.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * len(words[i]) / mean)) for t in both)
                scored.append((-round(float(s), 6), i))
        out += [(q, r, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return out


def test_search_is_brute_force_over_many_shards(spark):
    r = random.Random(4)
    vocabulary = [f"w{k}" for k in range(300)]
    pick = lambda n: " ".join(vocabulary[min(int(r.expovariate(1 / 40)), 299)] for _ in range(n))
    docs = [(i, pick(r.randrange(0, 80))) for i in range(900)] + [(1000, None), (1001, ""), (1002, "w1 w1"), (1003, "w1 w1"), (1004, pick(30_000)), (None, "w1")]
    queries = [(i, t) for i, t in docs if i is not None and i % 50 == 0] + [(-1, None), (-2, "zzz"), (-3, "w0"), (-4, "w1 w299"), (-5, "w1"), (-5, "w299"), (1004, docs[-2][1]), (None, "w1")]
    df = spark.createDataFrame(docs, DOCS).withColumn("id", F.lit("x")).withColumn("shard", F.lit(1))
    asked = spark.createDataFrame(queries, DOCS).withColumn("floor", F.lit(1e9)).withColumn("terms", F.lit("t"))
    known = [(i, t) for i, t in docs if i is not None]
    one = [(i, t) for i, t in queries if i not in (None, -5)] + [(-5, "w1 w299")]
    for shard_docs in (60, 5000):  # 16 shards in three rounds; one
        found = topk_search.search(topk_search.build_index(df, shard_docs=shard_docs), asked, k=7)
        assert sorted(rows_of(found)) == sorted(brute_search(known, one, 7))


def test_search_of_nothing_and_of_repeated_documents(spark):
    none = spark.createDataFrame([], DOCS)
    assert topk_search.search(topk_search.build_index(none), none).count() == 0
    assert topk_search.search(topk_search.build_index(none), spark.createDataFrame([(1, "a")], DOCS)).count() == 0
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, "a b"), (3, None)], DOCS)
    assert [(r.query_id, r.rank, r.doc_id) for r in topk_search.search(topk_search.build_index(docs), spark.createDataFrame([(9, "a")], DOCS)).orderBy("rank").collect()] == [(9, 1, 1), (9, 2, 1), (9, 3, 2)]
    assert topk_search.search(topk_search.build_index(docs), none).count() == 0


# Chat formatting


def test_chats_come_back_and_controls_are_escaped(spark):
    turns = [
        (1, 2, "assistant", "x <|im_end|>\n&lt;|"), (1, 0, "system", None), (1, 1, "user", "a\nb"), (1, 3, "assistant", "&amp;"), (1, 3, "assistant", "&amp;"),
        (2, None, None, "<|turn|>"), (2, 0, "ro\nle&nl;<|", "\U0001f600"), (None, 1, "assistant", "n"),
    ]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("conv", F.lit(9)).withColumn("rows", F.lit("z"))
    out = {r.conv_id: r for r in chat_format.format_chats(df).withColumn("back", chat_format.read_back(F.col("formatted"))).collect()}
    assert [(t.role, t.text) for t in out[1].back] == [("system", ""), ("user", "a\nb"), ("assistant", "x <|im_end|>\n&lt;|"), ("assistant", "&amp;"), ("assistant", "&amp;")]
    assert [(t.role, t.text) for t in out[2].back] == [("", "<|turn|>"), ("ro\nle&nl;<|", "\U0001f600")]
    assert out[1].formatted.count("<|im_start|>assistant") == 1 and out[1].formatted.count("<|turn|>") == 2
    assert [out[1].formatted[s.start : s.start + s.length] for s in out[1].loss] == ["x &lt;|im_end|>\n&amp;lt;|", "&amp;amp;", "&amp;amp;"]
    assert out[None].formatted == "<|im_start|>assistant\nn<|im_end|>\n" and out[2].loss == []
    assert chat_format.format_chats(df.limit(0)).count() == 0


# Language ID


def test_one_huge_conversation_and_one_huge_turn(spark):
    turns = [(1, k, ("user", "assistant")[k % 2], f"t{k}<|im_end|>") for k in range(20_000)] + [(2, 0, "user", "é" * 2_000_000), (2, 1, "assistant", None)]
    made = chat_format.format_chats(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    back = {r.conv_id: r.turns for r in made.select("conv_id", chat_format.read_back(F.col("formatted")).alias("turns")).collect()}
    assert [(t.role, t.text) for t in back[1]] == [x[2:] for x in turns[:-2]] and [len(t.text) for t in back[2]] == [2_000_000, 0]


def test_languages_on_held_out_texts_mixed_spans_and_scripts(spark):
    r = random.Random(2)
    sylls = {"aa": ["ka", "to", "ri", "mu"], "bb": ["sch", "ung", "ber", "ein"], "ru": ["ка", "то", "ри", "му"]}
    word = lambda g: "".join(r.choice(sylls[g]) for _ in range(3))
    text = lambda g, n: " ".join(word(g) for _ in range(n))
    model = lang_id.train(spark.createDataFrame([(k, text(g, 40), g) for k, g in enumerate(["aa", "bb", "ru"] * 20)] + [(900, None, "aa"), (901, "x", None)], "doc_id long, text string, lang string"))
    docs = [(k, text(g, 12)) for k, g in enumerate(["aa", "bb", "ru"] * 10)] + [(100, text("aa", 30) + ". " + text("bb", 20)), (101, None), (102, "12 !"), (103, text("aa", 50_000)), (104, "то"), (0, "ка")]
    df = spark.createDataFrame(docs, DOCS).withColumn("lang", F.lit("zz")).withColumn("id", F.lit(1))
    out = lang_id.identify(df, model).collect()
    assert len(out) == len(docs) and all(0 <= x.score <= 1 for x in out)
    by = {x.doc_id: x for x in out if x.doc_id}
    assert all(by[k].lang_pred == ["aa", "bb", "ru"][k % 3] for k in range(1, 30))
    mixed = docs[30][1]
    assert [(s.lang, mixed[s.start : s.stop]) for s in by[100].spans] == [("aa", mixed.split(". ")[0]), ("bb", mixed.split(". ")[1])]
    assert (by[101].lang_pred, by[102].lang_pred, by[102].spans, by[103].lang_pred, by[104].lang_pred) == ("und", "und", [], "aa", "ru")
    nothing = lang_id.train(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert {x.lang_pred for x in lang_id.identify(df, nothing).collect()} == {"und"}
    assert lang_id.identify(df.limit(0), model).count() == 0


def test_viterbi_is_the_best_of_all_labelings():
    import itertools

    r = np.random.default_rng(3)
    for _ in range(20):
        n = int(r.integers(1, 6))
        s = r.normal(size=(n, 3))
        best = max(itertools.product(range(3), repeat=n), key=lambda p: sum(s[i, x] for i, x in enumerate(p)) - 0.7 * sum(a != b for a, b in zip(p, p[1:], strict=False)))
        assert list(lang_id.viterbi(s, np.zeros(n, np.int64), 0.7)) == list(best)


# Toxicity


def test_toxicity_learns_words_and_not_identities(spark):
    r = random.Random(5)
    plain = [f"w{c}{d}" for c in "abcdefgh" for d in "abcdefgh"]
    rows = []
    for k in range(600):
        bad = k % 3 == 0
        words = r.choices(plain, k=30) + (["vilefool"] if bad else []) + (["muslim"] if r.random() < (0.8 if bad else 0.2) else [])
        rows.append((k, " ".join(words), int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    fair, plain_model = toxicity.train(df, df), toxicity.train(df, df, penalty=0.0)
    neutral, other = b"wab waa muslim", b"wab waa christian"
    assert abs(fair.score(neutral) - fair.score(other)) < 0.5 * abs(plain_model.score(neutral) - plain_model.score(other))
    assert fair.score(b"VILEFOOL!") > 0.3 > fair.score(neutral)
    docs = spark.createDataFrame([(1, "vilefool"), (2, None), (3, ""), (4, "waa " * 200_000 + "vilefool"), (4, "waa")], DOCS).withColumn("score", F.lit("clash"))
    out = rows_of(toxicity.score(docs, fair))
    assert [x[2] for x in sorted(out)] == [1, 0, 0, 0, 1] and all(0 <= x[1] <= 1 for x in out)
    assert sorted(x.doc_id for x in toxicity.drop_toxic(docs, fair).collect()) == [2, 3, 4]
    none = toxicity.train(df, df.limit(0))
    assert {x[2] for x in rows_of(toxicity.score(docs, none))} == {0}


# WARC


def test_archives_come_back(spark):
    tricky = "WARC/1.1\r\nWARC-Type: response\r\n\r\n\r\n\r\nx"
    pages = [(5, "http://a", "same"), (3, "http://b", "same"), (9, None, None), (8, "u\r\nX: y", ""), (7, "http://c", tricky), (6, "http://d", "é" * 300_000), (4, "http://e", "same"), (3, "http://b", "same"), (None, "http://f", "other")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).withColumn("id", F.lit(0))
    out = warc.archive(df).collect()
    assert len(out) == len(pages)
    for x in out:
        payload = next((h or "").encode() for i, _, h in pages if i == x.id)
        assert (x.payload_bytes, x.payload_digest) == (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode())
    assert {(x.id, x.type, x.refers_to) for x in out} == {(3, "response", None), (4, "revisit", 3), (5, "revisit", 3), (8, "response", None), (9, "revisit", 8), (7, "response", None), (6, "response", None), (None, "response", None)}
    assert {x.type for x in warc.archive(df, min_bytes=5).collect() if x.id in (3, 4, 5, 8, 9)} == {"response"}
    assert warc.archive(df.limit(0)).count() == 0


# Line dedup


def test_recurring_templates_are_dropped_and_first_lines_stay(spark):
    own = lambda k: " ".join(chr(97 + k) * n for n in (3, 2, 4, 1, 5))
    docs = [(k, f"{own(k)}\nContact us on day {k} or in month {k * k} of the year\nbye") for k in range(5)]
    docs += [(20, "same\nsame"), (20, "same\nsame"), (21, "same\nsame"), (22, None), (23, ""), (24, "\n\n")]
    docs += [(30 + k, f"The quick brown {name} jumps over the lazy dog of the old town") for k, name in enumerate(["fox", "cat", "cow", "fox"])]
    out = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(docs, DOCS).withColumn("print", F.lit("p")).withColumn("template", F.lit(1))).collect()}
    assert out[0].text == docs[0][1] and out[0].n_dropped == 0
    assert all(out[k].text == own(k) and (out[k].n_lines, out[k].n_dropped) == (3, 2) for k in range(1, 5))
    assert out[20].text == out[21].text == "same\nsame"  # copies of one document
    assert (out[22].text, out[22].n_lines, out[23].text, out[24].text) == (None, 0, "", "\n\n")
    assert [out[30 + k].text for k in range(4)] == [docs[-4][1], "", "", ""]
    assert "print" in out[0] and line_dedup.dedup_lines(spark.createDataFrame([], DOCS)).count() == 0


def test_passages_inside_longer_lines_are_dropped(spark):
    r = random.Random(8)
    words = lambda n: " ".join("".join(r.choices("abcdefgh", k=7)) for _ in range(n))
    passage = " ".join(words(n) + "." for n in (9, 20, 14, 60, 12))
    docs = [(k, f"{words(30)}. {passage} {words(20)}.\nThe end.") for k in range(4)] + [(10, f"{words(9)}.\n{passage}\n{words(8)}"), (11, f"{words(5)}. {passage}"), (12, None), (13, "The end."), (14, "\n \n  x. \n"), (15, f"\ue000 \ue001a\n{passage} \ue001b\ue000")]
    out = {x.doc_id: x.text for x in line_dedup.dedup_passages(spark.createDataFrame(docs, DOCS)).collect()}
    assert all(out[k] == docs[i][1] for i, k in ((0, 0), (6, 12), (7, 13), (8, 14)))  # the first stays, and what is short
    assert all(out[k] == docs[k][1].replace(passage + " ", "") for k in (1, 2, 3))
    assert out[15] == docs[9][1].replace(passage + " ", "")
    assert out[10] == docs[4][1].replace(passage, "") and out[11] == docs[5][1].replace(passage, "")


def test_long_passages_of_two_texts_are_dropped_but_not_of_near_copies(spark):
    r = random.Random(9)
    words = lambda n: " ".join("".join(r.choices("abcdefgh", k=7)) for _ in range(n))
    long, short, most = words(60), words(12), words(200)
    docs = [(1, f"{words(70)}\n{long}\n{short}"), (2, f"{words(80)}\n{long}\n{short}"), (3, f"{most}\n{words(40)}"), (4, f"{most}\n{words(40)}"), (5, f"{words(400)}\n{short[:40]}\n{most[::-1]}"), (6, most[::-1])]
    docs += [(2, docs[1][1]), (7, docs[0][1])]  # copies of whole texts count once
    out = {x.doc_id: x.text for x in line_dedup.dedup_passages(spark.createDataFrame(docs, DOCS)).collect()}
    assert [out[k] for k in (1, 3, 4, 5)] == [docs[k - 1][1] for k in (1, 3, 4, 5)]
    assert out[2] == docs[1][1].replace(f"{long}\n{short}", "") and out[6] == ""


# Packing


def test_packing_is_gapless_and_near_the_bound(spark):
    r = random.Random(6)
    docs = [(k, " ".join(r.choice(["alpha", "be", "gamma!", "<|endoftext|>", "\n\n", "été", "日本"]) for _ in range(int(r.expovariate(1 / 60))))) for k in range(300)] + [(900, None), (901, ""), (905, "dup"), (905, "dup"), (None, "x")]
    packed = packing.pack(spark.createDataFrame(docs, DOCS).withColumn("length", F.lit(1)).withColumn("bucket", F.lit("b")), TOKENIZER, length=64, with_ids=True)
    out = packed.collect()
    by = collections.defaultdict(list)
    for x in out:
        assert zlib.crc32(np.array(x.ids, "<u4").tobytes()) == x.ids_crc32 and len(x.ids) == x.length
        by[x.sequence_id].append((x.offset, x.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(x.length for x in out)
    assert len(by) <= -(-total // 64) * 1.02 + 1
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    expected = collections.Counter(tuple([*t.encode(text or "", add_special_tokens=False).ids, packing.END]) for _, text in docs)
    pieces = collections.defaultdict(list)
    for x in out:
        pieces[x.doc_id].append(x)
    for i, text in docs:
        if i not in (905, None):
            own = sorted(pieces[i], key=lambda x: x.piece)
            assert tuple(t for x in own for t in x.ids) in expected and [x.start for x in own] == [sum(y.length for y in own[:k]) for k in range(len(own))]
            assert all(x.length == 64 for x in own[1:])
    assert len(pieces[905]) == 2 and len(pieces[None]) == 1
    assert packing.sequences(packed).count() == len(by)
    assert packing.pack(spark.createDataFrame([], DOCS), TOKENIZER).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 40), max_size=20))
def test_plan_is_best_fit_decreasing(histogram):
    rooms = []
    for size in sorted(histogram, reverse=True):
        for _ in range(histogram[size]):
            fits = [r for r in rooms if r >= size]
            if fits:
                rooms.remove(min(fits))
                rooms.append(min(fits) - size)
            else:
                rooms.append(50 - size)
    used = collections.defaultdict(list)
    ranks = collections.defaultdict(list)
    for size, first, past, sequence, each, at in packing.plan(histogram, 50):
        for number in range(past - first):
            used[sequence + number // each].append((at + size * (number % each), size))
            ranks[size].append(first + number)
    assert {s: list(range(n)) for s, n in histogram.items()} == {s: sorted(v) for s, v in ranks.items()}
    for places in used.values():
        ends = [0]
        for offset, size in sorted(places):
            assert offset == ends[-1]
            ends.append(offset + size)
        assert ends[-1] <= 50
    assert len(used) == len(rooms)


def test_token_ids_of_very_long_runs_are_those_of_the_library(spark):
    own = packing.library(TOKENIZER)
    texts = [" " * 2_000_000, "a " + "\n" * 1_200_000 + " b<|endoftext|>", "x" * 1_000_000, "a b " * 300_000]
    for text in texts:
        assert packing.token_ids(text, TOKENIZER, None).tolist() == own.encode(text, add_special_tokens=False).ids
    found = packing.pack(spark.createDataFrame(list(enumerate([*texts, None])), DOCS), TOKENIZER).groupBy("doc_id").agg(F.sum("length").alias("n"))
    assert {r.doc_id: r.n for r in found.collect()} == {k: len(own.encode(text or "", add_special_tokens=False).ids) + 1 for k, text in enumerate([*texts, None])}


def test_a_tokenizer_of_another_kind_is_refused():
    with pytest.raises(ValueError, match="no plain byte-level BPE"):
        packing.encoder(public_tokenizers.path("word_bpe_49k.json"))


def test_token_ids_are_those_of_the_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    texts = ["", " ", "a  b\n\n c", "It's <|endoftext|>x", "ñandú Straße 12345 — “q”", "\x00\x1f", "é", "\U0001f600" * 3, "a" * 5000, "x <|endoftext|> <|endoftext|>"]
    assert [t.encode(x, add_special_tokens=False).ids for x in texts] == [packing.token_ids(x, TOKENIZER, None).tolist() for x in texts]


# Decontamination


def brute_hits(text, items, width):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hit, met = set(), set()
    for i, item in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), item or ""))
        n = min(width, len(w))
        for k in range(len(w) - n + 1) if n else ():
            for j in range(len(words) - n + 1):
                if words[j : j + n] == w[k : k + n]:
                    hit.update(range(j, j + n))
                    met.add(i)
    return len(words), hit, sorted(met)


def test_decontamination_is_brute_force_in_any_number_of_blocks(spark):
    r = random.Random(7)
    words = ["the", "Ünder", "x1", "é", "Q", "of"]
    pick = lambda n: "".join(r.choice(words) + r.choice([" ", ", ", "\n", "-"]) for _ in range(n))
    items = [(k, pick(r.randrange(1, 7))) for k in range(25)] + [(98, None), (99, "..."), (None, "the of the of"), (100, "the of x1")]
    docs = [(k, pick(r.randrange(0, 60))) for k in range(80)] + [(200, None), (201, ""), (202, "x1 " * 50_000), (3, "the")]
    df = spark.createDataFrame(docs, DOCS).withColumn("hits", F.lit("clash")).withColumn("id", F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = sorted((i, *brute_hits(t, [x for x in items if x[0] is not None], 4)) for i, t in docs)
    for size in (1 << 20, 40):
        out = decontam.contamination(df, bench, width=4, block_bytes=size).collect()
        assert sorted((x.doc_id, x.n_words, {k for h in x.hits for k in range(h.start, h.stop)}, x["items"]) for x in out) == expected
    texts = {i: t for i, t in docs if i != 3}
    for x in out:
        if x.doc_id in texts:
            assert [len(decontam.words_of(texts[x.doc_id][s.start : s.stop])) for s in x.spans] == [h.stop - h.start for h in x.hits]
    clean = sorted(x.doc_id for x in decontam.drop_contaminated(df, bench, width=4).collect())
    assert clean == sorted(i for i, _, hit, _ in expected if not hit)
    named = decontam.contamination(df, bench.withColumn("item_id", F.concat(F.lit("q"), F.col("item_id"))), width=4).collect()
    assert sorted((x.doc_id, sorted(x["items"])) for x in named) == sorted((i, sorted(f"q{k}" for k in met)) for i, _, _, met in expected)
    assert decontam.contamination(df.limit(0), bench).count() == 0 and decontam.contamination(df, bench.limit(0)).where("size(hits) > 0").count() == 0
