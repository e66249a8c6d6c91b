"""The features and the lexicon of the toxicity operator, against a version that goes word by word; and its fallbacks."""

from __future__ import annotations

import math
import random
import re
import unicodedata
import zlib

import numpy as np
import pytest

from sparkloom.llm import toxicity
from sparkloom.llm.toxicity import BEGINNINGS, FEATURES, MIN_Z, NEAR, SECOND_PERSON, Lexicon

from .fixtures import prose, texts

LETTERS_FOR = dict(zip("013457@$!|", "oieastasil", strict=True))


def is_letter(c):
    return c.isalnum() and not c.isdecimal() and re.match(r"\w", c) is not None and re.match(r"\d", c) is None


def words_of(low):
    return "".join(c if is_letter(c) else " " for c in low).split(" ")


def brute_features(text, lexicon):
    low = text.lower()
    words = [w for w in words_of(low) if w]
    whole = [w in lexicon.words for w in words]
    begins = [any(w.startswith(b) and len(w) > len(b) for b in lexicon.beginnings) for w in words]
    hits = [i for i in range(len(words)) if whole[i] or begins[i]]
    second = [i for i, w in enumerate(words) if w in SECOND_PERSON]
    odd = re.findall(r"[^\W\d_]+[0-9@$*!|.\-]+[^\W\d_]+", low) if set(low) & set("013457@$*!|") else []

    def known(w):
        return w in lexicon.words or any(w.startswith(b) and len(w) > len(b) for b in lexicon.beginnings)

    hidden = 0
    for w in odd:
        read = {"".join(c for c in s if is_letter(c)) for s in (w, "".join(LETTERS_FOR.get(c, c) for c in w))}
        hidden += sum(known(x) for x in read)
    ascii_letters = max(1, sum(c.isascii() and c.isalpha() for c in text))
    size, n = max(1, len(text.encode())), max(1, len(words))
    made = {
        "words": sum(whole) / n,
        "beginnings": sum(begins) / n,
        "count": math.log(1 + len(hits)),
        "hidden": hidden / n,
        "second": len(second) / n,
        "near": sum(any(abs(i - j) <= NEAR for j in second) for i in hits) / n,
        "capitals": sum("A" <= c <= "Z" for c in text) / ascii_letters,
        "marks": sum(c in "!?" for c in text) / size,
        "odd": len(odd) / n,
        "runs": len(re.findall(r"(\w)\1\1", low)) / n,
        "symbols": sum(c in "#*$%&|<>@^~_=+" for c in text) / size,
        "length": math.log(1 + len(words)),
    }
    return [made[f] for f in FEATURES]


def odd_texts():
    draw = random.Random(5)
    pieces = ["idiot", "Idiots", "stupid", "STUPIDITY", "you", "Your", "i.d.1.o.t", "st*pid", "1d10t", "noooo", "wow!!!", "ihr", "vous", "a_b", "é", "日本", "٣", "x9y", "--", "$$$", "<b>", "river", "²", "stu-pid"]
    return [t or "" for _, t in texts()] + [" ".join(draw.choice(pieces) for _ in range(draw.randint(1, 40))) for _ in range(300)] + ["".join(draw.choice("iIdDoOtT01@$!|. you") for _ in range(60)) for _ in range(100)]


def test_features():
    lexicon = Lexicon(frozenset({"idiot", "stupid", "river"}), frozenset({"stup", "idio", "bridge"}))
    known = {}
    for part in np.array_split(np.array(odd_texts(), object), 7):
        raw = [t.encode() for t in part]
        made = toxicity.slice_features(list(part), np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(r) for r in raw])).astype(np.int64), lexicon, known)
        for text, row in zip(part, made, strict=True):
            assert row == pytest.approx(brute_features(text, lexicon)), text


def brute_lexicon(rows):
    """Units of each text once: words, and beginnings of longer ones with a dash; shares compared by a z test."""
    bad, good = sum(y == 1 for _, y in rows), sum(y == 0 for _, y in rows)
    counts = {}
    for text, y in rows:
        words = {w for w in "".join(c if unicodedata.category(c)[0] == "L" else " " for c in text.lower()).split(" ") if w}
        for unit in words | {w[:k] + "-" for w in words for k in BEGINNINGS if len(w) > k}:
            t, n = counts.get(unit, (0, 0))
            counts[unit] = (t + y, n + 1)
    found = set()
    for unit, (t, n) in counts.items():
        if t >= 3 and n < bad + good:
            p = n / (bad + good)
            z = (t / bad - (n - t) / good) / math.sqrt(p * (1 - p) * (1 / bad + 1 / good))
            if z >= MIN_Z and (t / bad) / ((n - t + 1) / good) >= 4:
                found.add(unit)
    return {u for u in found if u[-1] != "-"}, {u[:-1] for u in found if u[-1] == "-"}


def toxic_rows(n=240):
    draw = random.Random(6)
    return [(prose(i, 40) + (" " + draw.choice(["you idiotic fool", "Stupidly blöde LEUTE", "idiots all"]) if i % 4 == 0 else ""), i % 4 == 0) for i in range(n)]


def test_lexicon(spark):
    rows = [(t, float(y)) for t, y in toxic_rows()]
    made = toxicity.learn_lexicon(spark.createDataFrame(rows, "_text string, _toxic double"))
    words, beginnings = brute_lexicon(rows)
    assert (set(made.words), set(made.beginnings)) == (words, beginnings)
    assert {"fool", "blöde"} <= words and "idio" in beginnings
    assert toxicity.learn_lexicon(spark.createDataFrame([r for r in rows if r[1] == 0], "_text string, _toxic double")) == Lexicon(frozenset(), frozenset())


def part_of(key):
    h = zlib.crc32(str(key).encode())
    return None if h % 3 == 1 else h // 3 % 4


def learned(spark, keep):
    """A model from rows of which keep says, by fold, whether the label is known."""
    rows = [(i, t, int(y)) for i, (t, y) in enumerate(toxic_rows(600))]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    labels = [(i, y) for i, _, y in rows if part_of(i) is not None and keep(part_of(i), y)]
    return docs, toxicity.learn(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"))


def test_without_a_second_class_to_calibrate_by_the_trees_score_alone(spark):
    docs, model = learned(spark, lambda part, y: part != toxicity.CALIBRATION or y == 0)
    assert model.trees is not None and model.calibration is None
    scores = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert np.mean([scores[i] > scores[i + 1] for i in range(0, 600, 4)]) > 0.95


@pytest.mark.parametrize(("keep", "share"), [(lambda part, y: False, 0.0), (lambda part, y: y == 1, 1.0)])
def test_without_two_classes_the_score_is_the_share(spark, keep, share):
    docs, model = learned(spark, keep)
    assert model.trees is None and {r.score for r in toxicity.score(docs, model).collect()} == {share}


def test_without_two_classes_in_the_folds_of_the_trees_the_score_is_the_share(spark):
    docs, model = learned(spark, lambda part, y: part == toxicity.CALIBRATION or y == 0)
    scores = {r.score for r in toxicity.score(docs, model).collect()}
    assert model.trees is None and len(scores) == 1 and 0 < scores.pop() < 1
