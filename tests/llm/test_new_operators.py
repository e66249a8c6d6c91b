"""Periodic runs, ranked lexical search and line dedup against brute force, with nulls, ties, repeats, long and no texts."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import html_text, lexical_search, line_dedup, near_duplicates, periodic_runs
from sparkloom.llm._shared import Scratch

from .fixtures import frame, prose, texts

# Periodic runs


def brute_runs(w):
    """Stretches of each period that can't be extended; of those with one extent, the least period is the smallest."""
    found = {}
    for d in range(1, len(w) // 4 + 1):
        x = 0
        while x + d < len(w):
            start = x
            while x + d < len(w) and w[x] == w[x + d]:
                x += 1
            if x > start and x + d - start >= max(6, 4 * d):
                found.setdefault((start, x + d), d)
            x += x == start
    return sorted((s, e - s, d) for (s, e), d in found.items())


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def made_of_repeats(draw):
    out = []
    for _ in range(draw.randint(1, 5)):
        block = [draw.randint(0, draw.choice([1, 2, 5])) for _ in range(draw.randint(1, 14))]
        out += block * draw.randint(1, 9) + block[: draw.randint(0, len(block))]
        out += [draw.randint(0, 50) for _ in range(draw.choice([0, 0, 7]))]
    return out


@pytest.mark.parametrize(("keys_words", "key_cells"), [(1 << 16, 16), (4, 1), (64, 2)])
def test_runs_of_words_made_of_repeats(monkeypatch, keys_words, key_cells):
    """Also with automata of a few blocks, and with blocks that are searched for by cells."""
    monkeypatch.setattr(periodic_runs, "KEYS_WORDS", keys_words)
    monkeypatch.setattr(periodic_runs, "KEY_CELLS", key_cells)
    draw = random.Random(keys_words)
    for _ in range(400):
        w = made_of_repeats(draw)
        assert periodic_runs.runs_of(np.array(w, np.int32), len(set(w))) == brute_runs(w)


def test_runs_of_very_long_texts():
    """One word again and again, and a long period: seeds inside a run that is known aren't extended."""
    n = 300_000
    assert periodic_runs.runs_of(np.zeros(n, np.int32), 1) == [(0, n, 1)]
    period = np.random.default_rng(1).permutation(50_000).astype(np.int32)
    assert periodic_runs.runs_of(np.concatenate([[50_000], np.tile(period, 5)]).astype(np.int32), 50_001) == [(1, 250_000, 50_000)]


def test_long_texts_are_split_in_pieces(monkeypatch):
    text = ("river  stone\n\t" * 50 + "x" * 90 + " é").encode()
    whole = periodic_runs.word_numbers(text)
    monkeypatch.setattr(periodic_runs, "PIECE_BYTES", 40)
    parts = periodic_runs.word_numbers(text)
    assert whole[0].tolist() == parts[0].tolist() and whole[1] == parts[1] == [b"river", b"stone", b"x" * 90, "é".encode()]


def with_runs():
    again = prose(31, 17)
    return texts() + [(40, "a b " * 3), (41, "a b " * 4 + "a"), (42, prose(30, 12) + " " + (again + "\n") * 6 + prose(32, 5)), (43, "\x1c   " * 9), (44, "b a a a a a a a b " * 5)]


def test_runs_of_rows(spark):
    made = periodic_runs.find_runs(frame(spark, with_runs()).withColumn("runs", F.lit("clash")))
    got = []
    for r in made.collect():
        assert r.source == "src0"
        got.append((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed))
    expected = []
    for k, t in with_runs():
        w = words_of(t)
        runs = brute_runs(w)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        expected.append((k, len(w), runs, " ".join(x for i, x in enumerate(w) if i not in gone)))
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert sum(len(x[2]) for x in got) > 5
    assert periodic_runs.find_runs(frame(spark).limit(0)).count() == 0


def test_longest_run_and_list(spark):
    df = spark.sql("SELECT array(named_struct('start', 5L, 'length', 9L, 'period', 2L), named_struct('start', 1L, 'length', 9L, 'period', 1L), named_struct('start', 0L, 'length', 8L, 'period', 2L)) AS runs UNION ALL SELECT array()")
    rows = df.select(periodic_runs.longest(F.col("runs")).alias("best"), periodic_runs.listed(F.col("runs")).alias("all")).collect()
    assert [(r.best and tuple(r.best), r.all) for r in rows] == [((1, 9, 1), "5,9,2\n1,9,1\n0,8,2\n"), (None, "")]


def test_echoes(spark):
    rows = [(i, prose(100 + i, 30 + i)) for i in range(120)] + [(500, None), (501, ""), (None, "a b"), (502, " \t")]
    expected = []
    for k, t in rows:
        w, h = words_of(t), zlib.crc32(str(k).encode()) if k is not None else 1
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            t = " ".join(w[i] if i < a else w[a + (i - a) % p] for i in range(n))
        expected.append((k, t))
    made = periodic_runs.with_echoes(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(map(tuple, made.collect()), key=repr) == sorted(expected, key=repr)
    assert sum(a != b for a, b in zip(rows, expected, strict=True)) > 5


# Ranked lexical search


def terms_of(t):
    return [m.lower() for m in re.findall(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").encode())]


def brute_ranks(docs, items, top=20):
    counted = [(k, t, Counter(terms_of(t))) for k, t in docs]
    counted = [x for x in counted if x[2]]
    n_docs, n_terms = len(counted), sum(c.total() for *_, c in counted)
    df = Counter(x for *_, c in counted for x in c)
    wanted = {}
    for k, t in items:
        wanted.setdefault(k, Counter()).update(terms_of(t))
    out = []
    for item, terms in wanted.items():
        scores = {}
        for k, t, c in counted:
            m = 100 - 25 + 25 * c.total() * n_docs // n_terms
            scores[k, t] = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (1_000_000_000 * c[x] // (1000 * c[x] + 12 * m)) for x, times in terms.items() if x in c)
        best = sorted((-s, k is None, k or 0, t) for (k, t), s in scores.items() if s > 0)[:top]
        out += [(item, r, None if none else k, -s) for r, (s, none, k, _) in enumerate(best, 1)]
    return out


def ranked_rows():
    rows = texts() + [(i, prose(200 + i, 40)) for i in range(50, 90)] + [(90, "Tie one two"), (91, "tie ONE three"), (92, "tie é１ one"), (93, "only")]
    items = [(1, prose(260, 40)), (2, "tie one"), (3, None), (4, ""), (5, "nowhere at-all"), (6, "é日🙂 X"), (6, "tie Tie"), (None, "stone river tie"), (7, "the of and to"), (8, "!!!")]
    return rows, items


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_ranks(spark, monkeypatch, broadcast):
    """Item terms broadcast, and joined by the buckets of the postings; the weighted terms too."""
    monkeypatch.setattr(lexical_search, "BROADCAST_TERMS", broadcast)
    rows, items = ranked_rows()
    wanted = spark.createDataFrame([(k, t, "x") for k, t in items], "item_id bigint, text string, term string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before if broadcast else "-1")
    try:
        made = lexical_search.rank_documents(frame(spark, rows), wanted)
        assert made.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted(map(tuple, made.collect()), key=repr) == sorted(brute_ranks(rows, items), key=repr)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("postings_")]


def test_a_kept_index_serves_many_searches(spark):
    rows, items = ranked_rows()
    with Scratch(spark) as store:
        name = lexical_search.build_postings(frame(spark, rows), store.path("postings"), buckets=8)
        try:
            for some in (items[:2], items[2:]):
                wanted = lexical_search.item_terms(spark.createDataFrame(some, "item_id bigint, text string"))
                made = lexical_search.search(spark.table(name), wanted, store, top=3)
                assert sorted(map(tuple, made.collect()), key=repr) == sorted(brute_ranks(rows, some, 3), key=repr)
        finally:
            spark.sql(f"DROP TABLE {name}")


def test_ranks_of_nothing(spark):
    rows, items = ranked_rows()
    none = spark.createDataFrame([], "doc_id bigint, text string")
    wanted = spark.createDataFrame(items, "item_id bigint, text string")
    assert lexical_search.rank_documents(none, wanted).count() == 0
    assert lexical_search.rank_documents(frame(spark, rows), wanted.limit(0)).count() == 0


def test_terms_of_long_texts_in_pieces(monkeypatch):
    text = ("River-stone É " * 30 + "y" * 50 + " end").encode()
    whole = lexical_search.count_terms(text)
    monkeypatch.setattr(lexical_search, "PIECE_BYTES", 11)
    assert lexical_search.count_terms(text) == whole == Counter({b"river": 30, b"stone": 30, "É".encode(): 30, b"y" * 50: 1, b"end": 1})


# Line dedup


def brute_lines(rows, min_chars=40, min_docs=5):
    def key(line):
        return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))

    holders = {}
    for k, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders.setdefault(key(line), set()).add((k is not None, k or 0, "" if k is not None else t))
    out = []
    for k, t in rows:
        lines = (t or "").split("\n")
        gone = [i for i, x in enumerate(lines) if len(h := holders.get(key(x), ())) >= min_docs and k != (max(h)[1] if max(h)[0] else None)]
        out.append((k, len(lines), len(gone), "\n".join(x for i, x in enumerate(lines) if i not in set(gone))))
    return out


def line_rows():
    common, other, rare = "This line is in many documents, more than four of them", "Ein anderer Satz, der in vielen Texten é 日 steht", "A line that only four documents have among all of them"
    rows = texts() + [(100 + i, "\n".join([prose(300 + i, 9), f"  {common}\t", common.upper(), prose(400 + i, 8)] + [other] * (i % 3) + ["", "short"])) for i in range(12)]
    rows += [(120 + i, rare) for i in range(4)] + [(130, common + "\r\n"), (130, other), (130, common), (130, common)]
    rows += [(None, common), (None, common), (None, "own " + common + " é\n" + common)]
    rows += [(None, f"without an id, text {i}\nA line that only documents without an id have, six") for i in range(6)]
    long = "\n".join(x for i in range(3000) for x in ([common] if i % 700 == 5 else [prose(1000 + i, 7)]))
    return rows + [(3, long), (2, "\n" * 200 + common + "\n" * 5000 + other)]


@pytest.mark.parametrize("broadcast", [1_000_000, -1])
def test_lines(spark, monkeypatch, broadcast):
    monkeypatch.setattr(line_dedup, "BROADCAST_WORDS", broadcast)
    made = line_dedup.drop_shared_lines(frame(spark, line_rows()).withColumn("kept", F.lit("clash")))
    assert {"source", "n_words", "rid"} <= set(made.columns)
    got = [(r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in made.collect()]
    expected = brute_lines(line_rows())
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert sum(x[2] for x in got) > 20 and any(k is None and n for k, _, n, _ in got)
    assert not re.search("Python|Pandas|Arrow", made._jdf.queryExecution().executedPlan().toString())


def test_bitmaps_leave_out_words_of_which_every_line_stays(spark):
    with Scratch(spark) as store:
        bitmaps = line_dedup.keep_bitmaps(frame(spark, line_rows()), store)
    by_size = sorted((r.n_dropped, [w.word for w in r.dropped]) for r in bitmaps.collect())
    longest = [5 + 700 * i for i in range(5)]
    assert (5, sorted({at // 64 for at in longest})) in by_size and (2, [3, 81]) in by_size


def test_a_hash_is_cut_into_slices(spark):
    """A line of all documents is in as many groups as there are slices, in the order of documents and positions."""
    line = "a line that every one of the documents has, here and there"
    lines = line_dedup.ordered_lines(spark.createDataFrame([(i, f"{line}\nx\n{line}") for i in range(400)], "doc_id bigint, text string"))
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning(_h1" in plan and "hashpartitioning" not in plan
    rows = lines.collect()
    assert len(rows) == 800 and sum(r._begins for r in rows) == 400
    groups = {}
    for r in rows:
        groups.setdefault(r._slice, []).append((-r._key, r._pos))
    assert len(groups) == line_dedup.SLICES and max(map(len, groups.values())) < 80 and all(x == sorted(x) for x in groups.values())


def test_lines_of_nothing(spark):
    assert line_dedup.drop_shared_lines(frame(spark).limit(0)).count() == 0


# Main text: what the rules decide

PROSE = " ".join("the river and the stone of the garden in a letter to the queen".split() * 5)
UNLIKE = " ".join(f"item{i} no{i}" for i in range(20))
LINKS = "".join(f"<li><a href='/{i}'>item {i} name</a></li>" for i in range(30))


@pytest.mark.parametrize("name", ["side-effects", "social history", "search-method", "alert", "tag", "plain", "header", "share"])
def test_prose_of_an_article_stays_whatever_it_is_about(name):
    for page in (f"<article><p>{PROSE}</p><p class='{name}'>{PROSE}</p></article>", f"<article><p>{PROSE}</p><div class='{name}'><p>{PROSE}</p></div></article>"):
        assert html_text.main_text(page) == f"{PROSE}\n\n{PROSE}"


@pytest.mark.parametrize("name", ["ad", "comment-list", "cookie-notice", "ad-box sticky", "related", "footer_links", "newsletter"])
def test_places_with_strong_names_go(name):
    for page in (f"<article><p>{PROSE}</p><p class='{name}'>{PROSE}</p></article>", f"<article><p>{PROSE}</p><div id='{name}'><p>{PROSE}</p></div></article>"):
        assert html_text.main_text(page) == PROSE


def test_weak_names_decide_what_is_left_open():
    assert html_text.main_text(f"<article><p>{PROSE}</p><div class='share'><p>Tell others</p></div><p class=x>Short</p></article>") == f"{PROSE}\n\nShort"


def test_links_in_an_article():
    """A menu inside goes; a paragraph that is a link follows its neighbours."""
    assert html_text.main_text(f"<article><p>{PROSE}</p><ul>{LINKS}</ul><p>{PROSE}</p></article>") == f"{PROSE}\n\n{PROSE}"
    assert html_text.main_text(f"<article><p>{PROSE}</p><p><a href=x>A linked line</a></p><p>{PROSE}</p></article>") == f"{PROSE}\n\nA linked line\n\n{PROSE}"
    assert html_text.main_text("<article><p>a <math>x+y</math> b <object>d</object></p></article>") == "a x+y b d"


@pytest.mark.parametrize(("setting", "value"), [("MIN_STOP", 0.0), ("LONG_WORDS", 10**9), ("MAX_LINKS", 1.0), ("LINK_ROW", 10**9), ("BORDER", 0)])
def test_each_rule_decides_labels(monkeypatch, setting, value):
    """With a rule switched off some label of these pages is another one."""
    pages = [
        f"<article><p>{PROSE}</p><ul>{LINKS}</ul><p>{PROSE}</p></article>",
        f"<div><ul>{LINKS}</ul></div><div><p>{UNLIKE}</p></div><div><ul>{LINKS}</ul></div><div><p>Short</p></div><div><p>{PROSE}</p><p>Another</p></div>",
        f"<div><div><p>{PROSE}</p></div><p>one</p><p>two</p><p><a href=x>Home page</a></p></div>",
    ]
    labels = lambda: [b.label for page in pages for b in html_text.classify(html_text.blocks(page))]
    before = labels()
    monkeypatch.setattr(html_text, setting, value)
    assert labels() != before


# Near-duplicates of few words


def changed(draw, words, n):
    words = list(words)
    for _ in range(n):
        kind = draw.choice("sid")
        if kind == "i":
            words.insert(draw.randint(0, len(words)), f"new{draw.randrange(10**6)}")
        elif kind == "s":
            words[draw.randrange(len(words))] = f"new{draw.randrange(10**6)}"
        elif len(words) > 1:
            del words[draw.randrange(len(words))]
    return words


def test_texts_of_few_words_share_a_segment_with_all_that_they_are_linked_to():
    draw, links = random.Random(7), 0
    for _ in range(4000):
        one = [draw.randrange(1, draw.choice([6, 10**9])) for _ in range(draw.randint(1, 37))]
        other = [int(re.sub("new", "", str(x))) for x in changed(draw, one, draw.randint(0, 7))]
        if min(len(one), len(other)) >= near_duplicates.BRIEF or not near_duplicates.distance_within(np.array(one), np.array(other), near_duplicates.edits(max(len(one), len(other)), 0.8)):
            continue
        links += 1
        found = [near_duplicates.segments(np.array(x, np.uint64) * np.uint64(0x9E3779B97F4A7C15), 0.8) for x in (one, other)]
        assert found[0] & found[1], (one, other)
    assert links > 1500


def test_links_of_texts_of_few_words_are_all_found(spark):
    """At the least similarity that a link may have, from 5 words on, and across the border to texts found by sketches alone."""
    draw, rows, expected = random.Random(8), [], {}
    for words in (5, 6, 8, 9, 10, 12, 15, 20, 25, 28, 29, 30, 33):
        for _ in range(40):
            one = [f"w{draw.randrange(10**6)}" for _ in range(words)]
            other = changed(draw, one, near_duplicates.edits(words, 0.8))
            longer = max(len(one), len(other))
            key = len(rows)
            rows += [(key, " ".join(one)), (key + 1, " ".join(other).upper())]
            linked = near_duplicates.distance_within(*(np.array([hash(x.lower()) for x in w]) for w in (one, other)), near_duplicates.edits(longer, 0.8))
            expected |= {key: (key, words), key + 1: (key if linked else key + 1, words)}
    made = {r.doc_id: r.class_id for r in near_duplicates.classes(frame(spark, rows)).collect()}
    missed = [words for k, (c, words) in expected.items() if made[k] != c]
    assert not [w for w in missed if w < near_duplicates.BRIEF] and len(missed) <= 0.1 * 80


def test_classes_don_t_depend_on_the_partitions(spark):
    draw = random.Random(9)
    rows = [(i, " ".join(changed(draw, prose(700 + i % 40, 20 + i % 60).split(" "), draw.randint(0, 4)))) for i in range(300)]
    made = [sorted(map(tuple, near_duplicates.classes(frame(spark, rows).repartition(n)).collect())) for n in (2, 7)]
    assert made[0] == made[1]
