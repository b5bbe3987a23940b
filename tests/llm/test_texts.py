from __future__ import annotations

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import quantell.llm.leaks as leaks
from quantell.functions.labels import clean_source
from quantell.llm.leaks import K, W, leaked_pairs, leaked_spans, run_hashes, winnow, word_hashes, words
from quantell.llm.mixing import in_order, mixture, reached, segments, when_demanded
from quantell.llm.splitting import character_spans, pieces, rebuilt, split_texts
from quantell.llm.tokens import PYTHON_TOKEN, token_count

DOCS = "doc_id long, text string, source string, item_id int, piece int, n int"
ITEMS = "item_id long, text string, doc_id int"


# Leaks


def test_words():
    assert words("<p>Café [b]NAÏVE[/b]</p><br />x&amp;y&#32;z Be&shy;fore ​zero​width") == "cafe naive x y z before zerowidth".split()
    assert words("> quoted line\n> > wo<i>rd</i>s, STRASSE · straße 42a") == "quoted line words strasse strasse 42a".split()
    assert words("if x < 8 and y > 3 <br>z") == "if x 8 and y 3 z".split()
    assert words("") == [] and words("<b></b> -- …") == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.lists(st.integers(0, 3), max_size=60), st.lists(st.integers(0, 3), min_size=K + W - 1, max_size=20))
def test_a_shared_span_keeps_a_hash_in_common(a, b, shared):
    h = [{int(x) for x in hs[winnow(hs)]} for hs in (run_hashes(word_hashes([str(w) for w in [*side, *shared, *side[::-1]]])) for side in (a, b))]
    assert h[0] & h[1]


def brute(docs, items, least=8):
    out = set()
    for d, t in docs:
        w = words(t or "")
        runs = {tuple(w[i : i + least]) for i in range(len(w) - least + 1)}
        for i, u in items:
            v = words(u or "")
            if any(tuple(v[k : k + least]) in runs for k in range(len(v) - least + 1)):
                out.add((d, i))
    return out


def corpus(seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(12)] + ["Été", "Straße"]
    line = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [(i, line(r.randrange(3, 30))) for i in range(25)]
    docs = [(d, line(r.randrange(0, 60))) for d in range(80)]
    docs += [(100 + k, line(9) + " <b>" + t.upper().replace(" ", "&nbsp;", 2) + "</b> " + line(4)) for k, (_, t) in enumerate(items)]
    return docs, items


def test_found_pairs_equal_brute_force(spark, monkeypatch):
    docs, items = corpus(4)
    df = spark.createDataFrame([(d, t, "s", 1, 2, 3) for d, t in docs], DOCS)
    it = spark.createDataFrame([(i, t, 0) for i, t in items], ITEMS)
    got = {(r.doc_id, r.item_id) for r in leaked_pairs(leaked_spans(df, it)).collect()}
    assert got == brute(docs, items) and len(got) > 10
    spans = sorted(map(tuple, leaked_spans(df, it).collect()))
    monkeypatch.setattr(leaks, "SHARED_WORDS", 60)  # too many to be shared: joined
    assert sorted(map(tuple, leaked_spans(df, it).collect())) == spans


def test_share_is_that_of_all_spans(spark):
    """One inserted word parts an item of 40 words into two spans, which cover it together; overlaps count once."""
    ws = [f"q{i}" for i in range(40)]
    docs = [(1, " ".join([*ws[:20], "new", *ws[20:]]), "", 0, 0, 0), (2, " ".join([*ws[:12], "x", *ws[4:16], "x", *ws[:12]]), "", 0, 0, 0)]
    got = leaked_pairs(leaked_spans(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(7, " ".join(ws), 0)], ITEMS))).collect()
    assert {r.doc_id: (r.n_spans, r.longest, r.share) for r in got} == {1: (2, 20, 1.0), 2: (3, 12, 0.4)}


def test_spans_are_maximal(spark):
    item = " ".join(f"q{i}" for i in range(30))
    doc = "x " + " ".join(f"q{i}" for i in range(3, 20)) + " y " + " ".join(f"q{i}" for i in range(22, 30))
    got = leaked_spans(spark.createDataFrame([(1, doc, "", 0, 0, 0)], DOCS), spark.createDataFrame([(7, item, 0)], ITEMS)).collect()
    assert sorted((r.doc_word, r.item_word, r.n_words) for r in got) == [(1, 3, 17), (19, 22, 8)]


@pytest.mark.parametrize("most", [2_000_000, 0])
def test_leaks_of_dirt_and_long_texts(spark, monkeypatch, most):
    monkeypatch.setattr(leaks, "SHARED_WORDS", most)
    text = " ".join(f"q{i}" for i in range(10))
    long = "z " * 200_000 + text
    d = [(1, None, "", 0, 0, 0), (None, text, "", 0, 0, 0), (2, "", "", 0, 0, 0), (3, long, "", 0, 0, 0), (4, text, "", 0, 0, 0), (4, text, "", 0, 0, 0), (5, "q0 q1", "", 0, 0, 0)]
    df, it = spark.createDataFrame(d, DOCS), spark.createDataFrame([(9, text, 0), (8, None, 0), (None, text, 0), (6, text, 0)], ITEMS)
    assert sorted((r.doc_id, r.item_id, r.n_spans) for r in leaked_pairs(leaked_spans(df, it)).collect()) == [(3, 6, 1), (3, 9, 1), (4, 6, 2), (4, 9, 2)]
    assert leaked_spans(df, it.limit(0)).count() == 0 and leaked_spans(df.limit(0), it).count() == 0
    with pytest.raises(ValueError):
        leaked_spans(df, it, least=5)


# Mixing


TARGETS = "source string, target_share double, max_repeats long"


def mix(spark, docs, targets, **args):
    df = spark.createDataFrame(docs, DOCS)
    copies, plan = mixture(df, spark.createDataFrame(targets, TARGETS), "doc_id", clean_source(F.col("source")), token_count(F.col("text")), clean_source(F.col("source")), **args)
    return copies, reached(copies, plan)


def sourced(n=400):
    r = random.Random(5)
    return [(i, "a b " * r.randrange(1, 30), r.choice(["Big ", "big", "big", "mid", "small", None, ""]) if i % 40 else "tiny", 0, 0, 0) for i in range(n)]


def test_shares_repeats_and_shortfalls(spark):
    docs = sourced()
    targets = [("big", 0.3, 1), ("MID", 0.4, 4), ("small", 0.2, 2), ("tiny", 0.1, 1), ("absent", 0.0, 3)]
    copies, plan = mix(spark, docs, targets)
    size = {d[0]: len(d[1].split()) for d in docs}
    plan = {r.source: r for r in plan.collect()}
    total = sum(size[d[0]] for d in docs if (d[2] or "").strip())
    made: dict = {}
    times: dict = {}
    for r in copies.collect():
        made[r.source] = made.get(r.source, 0) + r.tokens
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    for name, share, cap in (("big", 0.3, 1), ("mid", 0.4, 4), ("small", 0.2, 2), ("tiny", 0.1, 1)):
        own = sum(size[d[0]] for d in docs if (d[2] or "").strip().lower() == name)
        assert plan[name].tokens == own and plan[name].short == (cap * own < share * total)
        assert abs(made[name] - min(cap * own, share * total)) <= 60
        assert max(times[d[0]] for d in docs if (d[2] or "").strip().lower() == name and d[0] in times) <= cap
    assert plan["tiny"].short and not plan["absent"].short and plan["absent"].share == 0


def test_positions_follow_the_schedule(spark):
    docs = [(i, "a b c d", "up" if i % 2 else "down", 0, 0, 0) for i in range(2000)]
    points = spark.createDataFrame([("up", 0.0, 0.2), ("up", 1.0, 1.8), ("down", 0.0, 1.8), ("down", 1.0, 0.2)], POINTS)
    copies, _ = mix(spark, docs, [("up", 0.5, 1), ("down", 0.5, 1)], schedules=points)
    got = [(r.position, r.source) for r in in_order(copies, "doc_id").collect()]
    assert len(got) == 2000 and [p for p, _ in got] == sorted(p for p, _ in got)
    early = [s for p, s in got if p < 0.25]
    assert early.count("down") / len(early) == pytest.approx((1.8 * 0.25 - 1.6 * 0.25**2 / 2) / 0.5, abs=0.02)


POINTS = "source string, t double, weight double"


def test_schedules_of_several_lines(spark):
    """Positions invert the integral of the schedule, whatever its lines; bad points are left out."""
    points = [("a", 0.25, 0.0), ("a", 0.5, 2.0), ("a", 0.5, 1.0), ("a", 0.75, 0.5), ("b", 0.0, 0.0), ("b", 1.0, 2.0), ("c", 0.3, 0.0), ("a", None, 1.0), ("a", 0.9, -1.0), ("a", 7.0, 9.0), (None, 0.5, 9.0)]
    sources = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "source string")
    lines = segments(spark.createDataFrame(points, POINTS), sources).crossJoin(spark.range(0, 101).select((F.col("id") / 100).alias("share")))
    got = {(r.source, r.share): r.t for r in lines.select("source", "share", when_demanded(F.col("share"), F.col("lines"), F.col("area")).alias("t")).collect()}
    at = {"a": ([0, 0.25, 0.5, 0.75, 1], [0, 0, 2, 0.5, 0.5]), "b": ([0, 1], [0, 2]), "c": ([0, 1], [1, 1]), "d": ([0, 1], [1, 1])}
    fine = np.linspace(0, 1, 200_001)
    for name, (t, w) in at.items():
        v = np.interp(fine, t, w)
        total = np.concatenate([[0], np.cumsum((v[1:] + v[:-1]) / 2)])
        for share in (0.01, 0.1, 0.37, 0.5, 0.8, 0.99):
            assert got[name, share] == pytest.approx(float(np.interp(share, total / total[-1], fine)), abs=1e-4)


def test_mixing_dirt_and_empty(spark, rows):
    docs = [(None, "a", "big", 0, 0, 0), (1, None, "big", 0, 0, 0), (2, "", "big", 0, 0, 0), (3, "a b", None, 0, 0, 0), (4, "a b", "other", 0, 0, 0), (5, "a b c", "big", 0, 0, 0), (5, "a b c", "big", 0, 0, 0)]
    copies, plan = mix(spark, docs, [("big", 1.0, 2), (None, 0.5, 1), ("zero", None, None)])
    r = {x.source: x for x in plan.collect()}
    assert r["big"].tokens == 6 and r["big"].wanted == 8 and not r["big"].short and not r["zero"].short
    assert sum(x.tokens for x in copies.collect()) in (9, 6 + 3)
    a = rows(copies)
    b, _ = mix(spark, docs[::-1], [("big", 1.0, 2)])
    assert rows(b) == a
    copies, plan = mix(spark, [], [("big", 1.0, 2)])
    assert copies.count() == 0 and plan.first().share == 0 and not plan.first().short
    copies, plan = mix(spark, docs, [])
    assert copies.count() == 0 and plan.count() == 0


# Splitting


def tokens(t):
    return PYTHON_TOKEN.findall(t)


texts = st.lists(st.sampled_from(["word ", "w", ". ", "! ", "\n", "\n\n", "\n~~~\n", "é", "。", "  ", "-", "42 ", "\t", "​", "\U0001f600"]), max_size=150).map("".join)


@settings(max_examples=150, deadline=None)
@given(texts, st.integers(2, 12), st.data())
def test_pieces_cover_overlap_and_fit(text, limit, data):
    overlap = data.draw(st.integers(0, limit - 1))
    got = pieces(text, limit, overlap)
    assert "".join(text[s + k : e] for s, e, _, k, _ in got) == text
    all_ = tokens(text)
    at = 0
    for i, (s, e, n, _, _) in enumerate(got):
        own = tokens(text[s:e])
        assert len(own) == n <= limit
        assert own == all_[at : at + n]
        at += n - (overlap if i < len(got) - 1 else 0)
    assert at == len(all_)


def test_cuts_at_natural_boundaries():
    text = "one two three. four five six.\n\nseven eight nine ten. eleven twelve"
    ends = [text[:e].rstrip()[-4:] for _, e, _, _, _ in pieces(text, 10, 2)]
    assert ends[0] == "six." and pieces(text, 10, 2)[0][4] == "paragraph"
    assert pieces("a b c. d e f g h", 6, 1)[0][:2] == (0, 7)
    assert pieces("x" * 30, 10, 2, spans=character_spans)[0][4] == "character"
    with pytest.raises(ValueError):
        pieces("a", 5, 5)


def test_early_boundaries_count_where_no_other_does():
    run = " ".join("abcdefghijklmnopqrstuvwxyz")
    text = f"one two. three. {run}"
    got = pieces(text, 12, 2)
    assert text[: got[0][1]] == "one two. three. " and got[0][4] == "sentence"
    assert got[1][4] == "word" and got[1][2] == 12  # no end beyond the overlap
    assert "".join(text[b + shared : e] for b, e, _, shared, _ in got) == text


def test_split_and_rebuild(spark):
    r = random.Random(2)
    make = lambda n: "".join(r.choice(["alpha ", "beta. ", "gamma\n", "delta\n\n", "ü-", "\U0001f600 "]) for _ in range(n))
    long = {i: make(r.randrange(600, 4000)) for i in range(8)}
    long[8] = "x" * 500_000
    long[9] = "!? " * 60_000
    docs = [(i, t, "s", 1, 2, 3) for i, t in long.items()] + [(20, "short", "", 0, 0, 0), (21, None, "", 0, 0, 0), (None, long[0], "", 0, 0, 0), (22, "", "", 0, 0, 0)]
    df = spark.createDataFrame(docs, DOCS)
    parts = split_texts(df)
    assert {r.doc_id for r in parts.collect()} == {i for i, t in long.items() if len(tokens(t)) > 512}
    for p in parts.collect():
        assert len(tokens(p.text)) == p.n_tokens <= 512 and long[p.doc_id][p.start :].startswith(p.text)
    back = {r.doc_id: r.text for r in rebuilt(split_texts(df, all_texts=True).where("doc_id IS NOT NULL")).collect()}
    assert back == {i: t for i, t, *_ in docs if i is not None and t is not None}
    assert split_texts(df.limit(0)).count() == 0


def test_tokens_are_the_same_in_java_and_python(spark):
    odd = ["", " ", "a_b c-d", "½ ² Ⅷ", "हिन्दी", "x́y", "​‍ a", "\U0001d7d8\U0001f600!", "\x1c\x85\xa0 z", "　一二", "﻿q", "\r\n\t\x0b"]
    odd += ["".join(chr(c) for c in range(a, a + 400) if not 0xD800 <= c < 0xE000) for a in range(1, 12_000, 400)]
    known = F.regexp_replace("t", r"\p{Cn}", "").alias("t")  # Java may know fewer characters than Python
    got = spark.createDataFrame([(t,) for t in odd], "t string").select(known).select("t", token_count(F.col("t")).alias("n")).collect()
    assert [(r.t, r.n) for r in got if r.n != len(re.findall(r"\w+|[^\w\s]+", r.t))] == []
    assert spark.range(1).select(token_count(F.lit(None).cast("string"))).first()[0] == 0
