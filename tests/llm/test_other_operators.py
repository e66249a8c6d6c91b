from __future__ import annotations

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from sparkloom.llm import chat_format, html_text, near_duplicates, toxicity
from sparkloom.llm._shared import Scratch
from sparkloom.llm.components import components, joined_components

from .fixtures import frame, prose, texts

# Near-duplicates


def distance(a, b):
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (x != y)))
        before = now
    return before[-1]


def test_banded_alignment():
    draw = random.Random(1)
    for _ in range(400):
        a = [draw.randint(0, 3) for _ in range(draw.randint(0, 12))]
        b = [x if draw.random() < 0.7 else draw.randint(0, 3) for x in a][: draw.randint(0, 12)] + [draw.randint(0, 3)] * draw.randint(0, 2)
        limit = draw.randint(0, 5)
        assert near_duplicates.distance_within(np.array(a, np.uint32), np.array(b, np.uint32), limit) == (distance(a, b) <= limit)
    for _ in range(400):
        a = [draw.randint(0, 9) for _ in range(draw.randint(20, 60))]
        b = [x if draw.random() < 0.8 else draw.randint(0, 9) for x in a if draw.random() < 0.9][draw.randint(0, 15) :] + [draw.randint(0, 9)] * draw.randint(0, 4)
        limit = draw.randint(max(1, abs(len(a) - len(b))), max(len(a), len(b)) - 1)
        one, other = np.array(a, np.uint32), np.array(b, np.uint32)
        assert near_duplicates.distance_within(one, other, limit) == near_duplicates.distance_within(other, one, limit) == (distance(a, b) <= limit)
        assert near_duplicates._within_band(max(a, b, key=len), min(b, a, key=len), limit) == (distance(a, b) <= limit)


def brute_labels(rows, similarity=0.8):
    """A number for each row's class, by all pairs."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            longer = max(len(words[i]), len(words[j]))
            if not words[i] or not words[j] or abs(len(words[i]) - len(words[j])) > (1 - similarity) * longer:
                continue
            if rows[i][1] == rows[j][1] or distance(words[i], words[j]) <= int((1 - similarity) * longer + 1e-9):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


def brute_classes(rows, similarity=0.8):
    """Least id of each row's class."""
    label, least = brute_labels(rows, similarity), {}
    for (k, _), x in zip(rows, label, strict=True):
        if k is not None:
            least[x] = min(k, least.get(x, k))
    return [least.get(x) for x in label]


def near_rows():
    rows = [r for r in texts() if r[0] != 10] + [(None, None), (None, "")]
    base = prose(50, 150).split(" ")
    for i in range(12):
        draw, copy = random.Random(i), list(base)
        for _ in range(i % 4):
            copy[draw.randrange(len(copy))] = f"changed{i}"
        rows.append((100 + i, " ".join(copy)))
    return rows


def test_near_duplicates(spark):
    rows = near_rows()
    made = near_duplicates.classes(frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.class_id) for r in made), key=repr) == sorted(((k, c) for (k, _), c in zip(rows, brute_classes(rows), strict=True)), key=repr)
    copies = {r.doc_id: r.n_copies for r in made}
    assert copies[5] == copies[6] == 2 and copies[7] == 1


def marker():
    """A word that is the least element of any text that has it, so that with one sketch all such texts share a bucket."""
    words = [f"w{i}" for i in range(20_000)]
    ends = np.cumsum([len(w) for w in words])
    labelled, _ = near_duplicates.elements(*near_duplicates.hashed_words(np.frombuffer("".join(words).encode(), np.uint8), np.append(0, ends)), 1)
    return words[int(np.argmin(labelled * near_duplicates._MULTIPLY[0]))]


def in_one_bucket(spark, rows):
    made = near_duplicates.classes(frame(spark, rows), sketches_=1, minima=1, k=1, more=0)
    assert sorted((r.doc_id, r.class_id) for r in made.collect()) == sorted((k, c) for (k, _), c in zip(rows, brute_classes(rows), strict=True))


def edited(words, at, n, name):
    return words[:at] + [f"{name}x{i}" for i in range(n)] + words[at + n :]


def test_texts_that_joined_a_leader_are_compared_with_the_rest(spark):
    base = [marker(), *prose(70, 99).split(" ")]
    star = [(10 + i, " ".join(edited(base, 1 + 16 * i, 15, f"s{i}"))) for i in range(6)] + [(50, " ".join(base))]
    chain, steps = [marker(), *prose(71, 99).split(" ")], []
    for i in range(6):
        steps.append((60 + i, " ".join(chain)))
        chain = edited(chain, 1 + 16 * i, 15, f"c{i}")
    assert set(brute_classes(star + steps)) == {10, 60}
    in_one_bucket(spark, star + steps)


def test_texts_behind_the_last_leader_are_compared(spark):
    rows = []
    for i in range(12):
        words = [marker(), *prose(80 + i, 30).split(" ")]
        rows += [(10 + i, " ".join(words)), (100 + i, " ".join(edited(words, 5, 3, "e")))]
    assert set(brute_classes(rows)) == set(range(10, 22))
    in_one_bucket(spark, rows)


def block_tables(spark, shared, label_of, words=None):
    """members, labels and sequences of nodes with these buckets; texts are alike unless words are given."""
    def packed(node):
        text = (words or {}).get(node, range(50))
        return node, len(text), zstandard.ZstdCompressor().compress(np.array(text, "<u4").tobytes())

    members = spark.createDataFrame([(n, b) for n, buckets in shared.items() for b in buckets], "node bigint, bucket bigint")
    labels = spark.createDataFrame(list(label_of.items()), "id bigint, label bigint")
    return members, labels, spark.createDataFrame([packed(n) for n in shared], "node bigint, n bigint, words binary")


def test_the_largest_component_stands_once_for_all_its_buckets(spark):
    """One text outside shares 20 buckets with a component of 40."""
    shared = {n: range(20) for n in range(41)}
    with Scratch(spark) as store:
        rows = near_duplicates._blocks(*block_tables(spark, shared, dict.fromkeys(range(40), 0)), store).collect()
    assert sorted((r.node, r.first) for r in rows) == [*((n, False) for n in range(40)), (40, True)]


@pytest.mark.parametrize("block", [3, 512])
def test_every_pair_across_components_meets(spark, monkeypatch, block):
    monkeypatch.setattr(near_duplicates, "BLOCK", block)
    draw = random.Random(block)
    shared = {n: draw.sample(range(12), draw.randint(1, 3)) for n in range(60)}
    label_of = {n: draw.choice([0, 0, 1, 2, 3, n]) for n in range(60)}
    label_of |= {x: x for x in label_of.values()}
    with Scratch(spark) as store:
        blocks = near_duplicates._blocks(*block_tables(spark, shared, label_of), store).toPandas()
    met = set()
    for _, rows in blocks.groupby(near_duplicates._BLOCK_KEY):
        met |= {tuple(sorted(p)) for p in near_duplicates._possible(pa.RecordBatch.from_pandas(rows, preserve_index=False), 0.8)}
    wanted = {(a, b) for a in shared for b in shared if a < b and label_of[a] != label_of[b] and set(shared[a]) & set(shared[b])}
    assert wanted <= met


def test_texts_of_a_component_without_a_common_bucket_are_not_linked(spark):
    """Text 3 shares a bucket with text 0, which is another text, but none with text 1, which is the same one."""
    shared = {0: [7], 1: [8], 2: [7, 8], 3: [7]}
    tables = block_tables(spark, shared, dict.fromkeys(range(3), 0), {0: range(100, 150), 2: range(100, 150)})
    for more, links in ({}, []), ({1: [7, 8]}, [(3, 1)]):
        members = block_tables(spark, shared | more, {})[0]
        with Scratch(spark) as store:
            made = near_duplicates._links_across(members, *tables[1:], 0.8, store).collect()
        assert [tuple(r) for r in made] == links


def test_one_of_each_class_stays(spark):
    rows = near_rows()
    docs = frame(spark, rows)
    kept = near_duplicates.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(brute_kept(rows), key=repr)
    assert near_duplicates.classes(docs.limit(0)).count() == 0
    assert near_duplicates.deduplicate(docs.limit(0)).count() == 0


def brute_kept(rows):
    """One row of each class, as deduplicate() chooses it; rows without words and rows alike in id and text all stay."""
    label, best = brute_labels(rows), {}
    for (k, t), x in zip(rows, label, strict=True):
        rank = (k is None, k or 0, hashlib.sha256((t or "").encode()).digest()[:16])
        best[x] = min(rank, best.get(x, rank))
    out, seen = [], set()
    for (k, t), x in zip(rows, label, strict=True):
        if not (t or "").strip(" \t\n\x0b\f\r"):
            out.append((k, t))
        elif (k is None, k or 0, hashlib.sha256(t.encode()).digest()[:16]) == best[x] and not (k is None and t in seen):
            out.append((k, t))
            seen.add(t)
    return out


def test_rows_without_ids_stay(spark):
    one, two, three = prose(90, 60), prose(91, 60), prose(92, 60)
    rows = [(None, one), (1, one + " more"), (None, two), (None, two), (2, three), (None, three), (None, ""), (3, "")]
    made = near_duplicates.classes(frame(spark, rows)).collect()
    assert sorted((r.class_id for r in made), key=repr) == sorted(brute_classes(rows)[:6] + [None, 3], key=repr)
    kept = near_duplicates.deduplicate(frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=repr) == sorted([(1, one + " more"), (None, two), (2, three), (None, ""), (3, "")], key=repr)


def test_texts_of_one_id_keep_their_own_links(spark):
    one, two = prose(93, 60), prose(94, 60)
    rows = [(5, one), (5, two), (6, one + " x"), (7, two + " x")]
    assert [r.class_id for r in near_duplicates.classes(frame(spark, rows)).collect()] == [5] * 4


def test_very_long_texts(spark):
    long = prose(95, 60_000).split(" ")
    other = list(long)
    for i in range(0, 60_000, 40):
        other[i] = "changed"
    rows = [(1, " ".join(long)), (2, " ".join(other)), (3, prose(96, 60_000)), (4, prose(97, 30))]
    assert {r.doc_id: r.class_id for r in near_duplicates.classes(frame(spark, rows)).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}


@pytest.mark.parametrize("words", [30, 50, 200, 1000])
def test_share_of_links_that_become_candidates(words):
    """Substitutions spread over the text, at the similarity that a link needs at least and above."""
    draw, vocabulary = random.Random(words), [f"w{i}" for i in range(5000)]
    for similarity in (0.8, 0.85, 0.9, 0.95):
        pairs = []
        for _ in range(100):
            one = [draw.choice(vocabulary) for _ in range(words)]
            other = list(one)
            for i in draw.sample(range(words), int((1 - similarity) * words + 1e-9)):
                other[i] = draw.choice(vocabulary)
            pairs += [one, other]
        flat = [" ".join(p).encode() for p in pairs]
        scan, hashes = near_duplicates.hashed_words(np.frombuffer(b"".join(flat), np.uint8), np.append(0, np.cumsum([len(f) for f in flat])))
        nd = near_duplicates
        made, begin = nd.all_sketches(*nd.elements(scan, hashes, nd.K), nd.SKETCHES, nd.MINIMA, nd.MORE_SKETCHES)
        own = [set(made[a:b].tolist()) for a, b in zip(begin[:-1], begin[1:], strict=True)]
        assert np.mean([bool(a & b) for a, b in zip(own[::2], own[1::2], strict=True)]) >= 0.9


def test_sketches_are_those_of_all_elements():
    draw = np.random.default_rng(3)
    sizes = [0, 1, 2, 3, 40, 900, 5000]
    labelled, first = draw.integers(1, 2**63, sum(sizes), dtype=np.uint64), np.append(0, np.cumsum(sizes))
    made = near_duplicates.sketches(labelled, first, 20, 2)
    for t, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)):
        for j in range(20):
            places = np.sort(np.argsort(labelled[a:b] * near_duplicates._MULTIPLY[j])[:2])
            value = np.full(1, np.uint64(j + 1))
            for i in range(2):
                value = near_duplicates.tx.mix(value * near_duplicates._PLACE[i] + (labelled[a:b][places[i]] if i < len(places) else np.uint64(0)))
            assert made[t, j] == (value[0] if b > a else 0)


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(60, 50), (50, 70)], "a bigint, b bigint")
    nodes = spark.createDataFrame([(i,) for i in range(1, 81)], "id bigint")
    with Scratch(spark) as store:
        found = {r.id: r.label for r in components(nodes, links, store).collect()}
        assert all(found[i] == 1 for i in range(1, 41)) and found[60] == found[70] == found[50] == 50 and found[80] == 80
        more = spark.createDataFrame([(40, 70), (80, 79), (60, 60)], "a bigint, b bigint")
        joined = {r.id: r.label for r in joined_components(components(nodes, links, store).where("id < 71 AND id not between 41 and 49"), more, store).collect()}
        assert all(joined[i] == 1 for i in (1, 40, 50, 60, 70)) and joined[79] == joined[80] == 79
        assert components(nodes, links.limit(0), store).where("id <> label").count() == 0


# Toxicity


def test_toxicity_on_rows_kept_from_learning(spark):
    bad = ["wretch", "dunce", "vermin"]
    rows, labels = [], []
    for i in range(600):
        words, toxic = prose(1000 + i, 60).split(" "), i % 4 == 0
        for j in range(4 if toxic else 0):
            words.insert(j * 12, bad[(i + j) % 3])
        rows.append((i, " ".join(words)))
        if i % 5:
            labels.append((i, 1, int(toxic)))
    docs, marks = frame(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    model = toxicity.learn(docs, marks)
    made = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert set(bad) <= model.lexicon.words
    for i, r in made.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    held = [(made[i].predicted, i % 4 == 0) for i in made if made[i].held_out]
    assert np.mean([a == b for a, b in held]) > 0.95
    # Labels of rows kept from learning change nothing.
    other = toxicity.learn(docs, marks.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic"))))
    assert {r.doc_id: r.score for r in toxicity.score(docs, other).collect()} == {i: r.score for i, r in made.items()}


def test_lexicon_is_not_learned_from_the_fold_that_calibrates(spark):
    """Words that mark toxic texts of the calibration fold alone are in no lexicon."""
    rows, labels = [], []
    for i in range(900):
        crc = zlib.crc32(str(i).encode())
        if crc % 3 == 1:
            continue
        toxic, last = i % 4 == 0, crc // 3 % 4 == toxicity.CALIBRATION
        words = prose(2000 + i, 40).split(" ")
        rows.append((i, " ".join(words[:20] + (["wretch" if last else "dunce"] * 3 if toxic else []) + words[20:])))
        labels.append((i, 1, int(toxic)))
    model = toxicity.learn(frame(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    assert "dunce" in model.lexicon.words and "wretch" not in model.lexicon.words


def test_toxicity_of_nothing_and_with_clashing_columns(spark):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(60)], "doc_id bigint, quality int, toxic int")
    docs = frame(spark, [(i, prose(i, 30)) for i in range(60)] + [(None, None), (61, "")]).selectExpr("*", "'x' AS score", "'y' AS held_out", "1 AS predicted", "2 AS _features")
    model = toxicity.learn(docs, labels)
    made = toxicity.score(docs, model)
    assert made.columns == ["doc_id", "held_out", "score", "predicted"] and made.count() == 62
    assert made.where("score < 0 OR score > 1 OR score IS NULL").count() == 0
    assert toxicity.score(docs.limit(0), model).count() == 0
    empty = toxicity.learn(docs.limit(0), labels.limit(0))
    assert toxicity.score(docs, empty).where("score = 0").count() == 62


def test_toxicity_without_labels(spark):
    docs = frame(spark)
    for labels in ([], [(1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 1, 1)]):
        model = toxicity.learn(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
        assert {r.score for r in toxicity.score(docs, model).collect()} == {1.0 if labels else 0.0}


# Chat


def test_template_is_reversible():
    draw = random.Random(4)
    for _ in range(300):
        turns = [(draw.choice(["user", "assistant", "", "a\n[b]"]), "".join(draw.choice(["[INST]", "</s>", "\\", "\\1", "ab", " ", "\n", "é"]) for _ in range(draw.randint(0, 6)))) for _ in range(draw.randint(1, 6))]
        made = chat_format.render(turns, chat_format.inst_template)
        assert chat_format.parse(made.formatted) == turns and not made.rewritten
        assert [chat_format.unescape(made.formatted[a:b]) for a, b in made.spans] == [t for _, t in turns]


def test_templates_that_rewrite_history():
    turns = [("user", "one"), ("assistant", "two"), ("user", "three")]
    counting = lambda t: f"{len(t)} turns: " + "|".join(x for _, x in t)
    dropping = lambda t: "|".join(x for r, x in t if r == "user" or (r, x) == t[-1])
    assert chat_format.render(turns, counting).rewritten and chat_format.render(turns, dropping).rewritten
    assert chat_format.render(turns, counting).spans == []


def test_chat_rows(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, None, None), (3, 0, "user", "x"), (3, 0, "user", "x"), (None, 0, "user", "n"), (4, 0, "assistant", "long " * 50_000)]
    turns = spark.createDataFrame([(*r, "more") for r in rows], "conv_id bigint, turn bigint, role string, text string, formatted string")
    made = {r.conv_id: r for r in chat_format.read_back(chat_format.format_conversations(turns)).collect()}
    assert {k: (r.n_turns, r.loss_chars) for k, r in made.items()} == {1: (2, 1), 2: (1, 0), 3: (2, 0), None: (1, 0), 4: (1, 250_000)}
    assert chat_format.format_conversations(turns.limit(0)).count() == 0


# Pages


ARTICLE = "<p>First of the lines &amp; more.</p><p><b>Second<br>line of <a href='x'>the</a> text</p><p>Short.</p>"
EXPECTED = "First of the lines & more.\n\nSecond line of the text\n\nShort."


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href=/a>Menu</a></li></ul></nav><div class=ad>Buy the best of all</div><article>{ARTICLE}</article><footer>&copy; us</footer>", EXPECTED),
        (f"<body><header><h2>Site</h2></header><aside>Side <p>bar</p></aside><main>{ARTICLE}<form><input>Send <p>this</form><section id='comments'><p>I like the text of this page and all that you say in it.</p></section></main>", EXPECTED),
        (f"<article><div class='cookie-notice'><p>We use cookies</p></div>{ARTICLE}<div hidden><p>no</p></div><!-- <p>not this</p> --></article><p>after the article</p>", EXPECTED),
        ("", ""),
        (None, ""),
        ("<p>only", "only"),
        ("plain &lt;text&gt; \n with   space", "plain <text> with space"),
        ("<article><p title='a > b'>One <script>x</script>two</p><p it's>three</p><p data-x=\"four>five</p>six", "One two\n\nthree\n\nfive\n\nsix"),
        ("<article><p><a href=x>A paragraph that is a link</a></p><svg>no end<p>1 < 2 <3</p></article>", "A paragraph that is a link\n\nno end\n\n1 < 2 <3"),
        ("<nav><p>in</nav><p>text</p><!-- no end <p>gone</p>", "text"),
    ],
)
def test_main_text(page, text):
    assert html_text.main_text(page) == text


def test_ambiguous_blocks_follow_their_neighbours():
    long = "the river and the stone of the garden are in a letter to the queen that was on the table of the house by the bridge " * 2
    page = f"<div><p><a>Home</a> <a>News</a></p><p>Menu</p><p>{long}</p><p>Short one.</p><p>{long}</p><p><a>Next page</a></p><p>End</p></div>"
    made = html_text.classify(html_text.blocks(page))
    assert [b.label for b in made] == ["bad", "bad", "good", "good", "good", "bad", "bad"]
    assert [b.why for b in made] == ["links", "neighbour", "prose", "neighbour", "prose", "links", "neighbour"]


def built(draw, marked):
    """A page made of known parts, and the paragraphs of its article. Unmarked pages have no telling tag, class or id."""
    paragraphs = [prose(draw.randrange(10**6), draw.choice([2, 5, 12, 30, 80, 200])) for _ in range(draw.randint(3, 12))]
    paragraphs[draw.randrange(len(paragraphs))] = prose(draw.randrange(10**6), 60)
    body = "".join(f"<p>{p.replace(' ', draw.choice([' ', chr(10), '<b> </b>']), 1)}</p>" for p in paragraphs)
    menu = "".join(f"<li><a href='/{i}'>{prose(draw.randrange(10**6), 2)}</a></li>" for i in range(8))
    if not marked:
        return f"<div><div><ul>{menu}</ul></div><div><div>{body}</div></div><div><ul>{menu}</ul></div></div>", paragraphs
    parts = [f"<nav><ul>{menu}</ul></nav>", f"<div class='ad'>{prose(1, 12)}</div>", f"<aside><p>{prose(2, 40)}</p></aside>", f"<form><label>{prose(3, 9)}</label></form>"]
    draw.shuffle(parts)
    comments = f"<section class='comments'><p>{prose(4, 80)}</p></section>"
    return f"<html><head><title>{prose(5, 6)}</title><style>p{{}}</style></head><body>{''.join(parts)}<article>{body}</article>{comments}<footer>{prose(6, 30)}</footer></body></html>", paragraphs


def test_built_pages_and_what_decides_their_blocks():
    draw, why = random.Random(12), []
    for _ in range(60):
        page, paragraphs = built(draw, marked=True)
        assert html_text.main_text(page) == "\n\n".join(" ".join(p.split()) for p in paragraphs)
        why += [b.why for b in html_text.classify(html_text.blocks(page))]
    assert np.mean([w != "place" for w in why]) > 0.7
    right = []
    for _ in range(60):
        page, paragraphs = built(draw, marked=False)
        right += [(b.label == "good") == (b.text in paragraphs) for b in html_text.classify(html_text.blocks(page))]
    assert np.mean(right) > 0.9


@pytest.mark.parametrize("part", ["<a ", '<a title="x', "<p a='", "<div>", "<!--", "<script>", "<svg>", "<", "</", "<a href=\"<b '>\" ", "<p>x"])
def test_very_long_broken_pages_are_read_in_one_scan(part):
    began = time.perf_counter()
    html_text.main_text(part * (1_000_000 // len(part)))
    assert time.perf_counter() - began < 10


def test_pages(spark):
    pages = spark.createDataFrame([(1, "u", f"<article>{ARTICLE}</article>", "t", 5), (2, None, None, "t", 5), (3, "u", "<p>" + "x " * 200_000, "t", 5)], "page_id bigint, url string, html string, text string, n_chars int")
    made = {r.page_id: r for r in html_text.extract(pages).collect()}
    assert made[1].text == EXPECTED and made[1].n_chars == len(EXPECTED) and made[2].text == "" and made[3].n_chars == 399_999
    assert html_text.extract(pages.limit(0)).count() == 0
