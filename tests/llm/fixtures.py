"""Texts with nulls, empty and very long ones, ties, repeated rows and clashing columns."""

from __future__ import annotations

import random
import re

WORDS = "the of and to in river stone garden window letter morning evening silver castle bridge winter summer forest mountain paper".split()


def prose(seed: int, n: int) -> str:
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) + (draw.choice([".", ",", ""]) if draw.random() < 0.2 else str(draw.randint(0, 99)) if draw.random() < 0.3 else "") for _ in range(n))


def texts() -> list[tuple[int | None, str | None]]:
    shared, copied = prose(1, 60), prose(2, 120)
    changed = copied.split(" ")
    changed[40] = "different"
    rows: list[tuple[int | None, str | None]] = [
        (1, None), (2, ""), (3, " \n\t "), (4, "one two three"), (5, copied), (6, copied), (7, " ".join(changed)), (8, prose(3, 200) + " " + shared), (9, shared + "\n" + prose(4, 90)),
        (10, prose(5, 20_000)), (11, "The " * 400), (12, "é日🙂" * 300), (13, prose(6, 50)), (13, prose(7, 50)), (14, prose(8, 70)), (14, prose(8, 70)), (None, prose(9, 40)),
        (15, "a  b\n\n c\t\td '" + "x" * 500), (16, "<|endoftext|> you IDIOT!! {x} </s> \x01 end"), (17, "line one is here\nline one is here\n\nother line\n"),
    ]
    return rows


def frame(spark, rows=None):
    """With more columns than the operators know, named as some of theirs."""
    made = [(k, t, "src0", 7, True, "x") for k, t in (texts() if rows is None else rows)]
    return spark.createDataFrame(made, "doc_id bigint, text string, source string, n_words int, kept boolean, rid string").repartition(3)


def item_words(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
