"""Quality rules as a short-circuit cascade whose order comes from measured cost and selectivity.

Every rule is a predicate over a slice of texts, by features that rules may share. Each task takes its own first slice as
the sample: ``plan`` times the features on it, counts what the rules reject, and puts next, again and again, the rule that
rejects most of what is left per second of the features that it still needs. The rules then run in that order, and each
sees only the texts that the rules before it let pass. So samples are spread over the table, no row goes to the driver,
and no text is read twice. The order changes the time, never the verdict: a text is kept if no rule rejects it.

Defined cases: null and empty texts have no words and fail the base rule; an empty table gives an empty result;
repeated rows and repeated ids are judged each on its own; further columns pass through, except that the result's
own columns replace columns of the same name.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sparkloom.llm import _text as tx

MIN_WORDS = 20
REPEAT_PERCENT = 30
WINDOW = 8

_WHITE = tx.separator_table(tx.WHITE)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_CODE_POINT = np.ones(256, bool)
_CODE_POINT[0x80:0xC0] = False
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_ASCII_LETTER = _UPPER.copy()
_ASCII_LETTER[97:123] = True

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


class Slice:
    """A slice of texts; what several rules need is computed once, when first asked for."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        self._known: dict[str, np.ndarray] = {}

    def only(self, rows: np.ndarray) -> Slice:
        if len(rows) == len(self.offsets) - 1:
            return self
        part = Slice(
            np.concatenate([self.data[self.offsets[r] : self.offsets[r + 1]] for r in rows] or [self.data[:0]]),
            np.concatenate([[0], np.cumsum(np.diff(self.offsets)[rows])]).astype(np.int64),
        )
        part._known = {k: v[rows] for k, v in self._known.items()}
        return part

    def get(self, name: str) -> np.ndarray:
        if name not in self._known:
            self._known[name] = getattr(self, f"_{name}")()
        return self._known[name]

    def _n_symbols(self):
        return tx.per_text_sum(_SYMBOL[self.data], self.offsets)

    def _n_words(self):
        self._scan = tx.Words(self.data, self.offsets, _WHITE)
        return self._scan.per_text.astype(np.int64)

    def _word_chars(self):
        return tx.per_text_sum((_CODE_POINT & ~_WHITE)[self.data], self.offsets)

    def _upper(self):
        return tx.per_text_sum(_UPPER[self.data], self.offsets)

    def _letters(self):
        return tx.per_text_sum(_ASCII_LETTER[self.data], self.offsets)

    def _n_lines(self):
        return self._line_table()[0]

    def _n_dup_lines(self):
        return self._line_table()[1]

    def _line_table(self):
        n = len(self.offsets) - 1
        newline = np.flatnonzero(self.data == 10)
        start = np.unique(np.concatenate([self.offsets[:-1], newline + 1]))
        start = start[start < len(self.data)]
        text = np.searchsorted(self.offsets, start, side="right") - 1
        end = np.append(start[1:], len(self.data))
        end = end - (self.data[end - 1] == 10) if len(self.data) else start
        words = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum(~_WHITE[self.data], out=words[1:])
        end = np.maximum(end, start)
        good = words[end] > words[start]
        text, line = text[good], tx.span_hashes(self.data, start[good], end[good])
        order = np.lexsort((line, text))
        same = np.zeros(len(order), bool)
        same[1:] = (text[order][1:] == text[order][:-1]) & (line[order][1:] == line[order][:-1])
        self._known["n_lines"] = np.bincount(text, minlength=n).astype(np.int64)
        self._known["n_dup_lines"] = np.bincount(text[order][same], minlength=n).astype(np.int64)
        return self._known["n_lines"], self._known["n_dup_lines"]

    def _hashes(self):
        """Hashes of the words of all texts; not by text, so not among what only() keeps."""
        if not hasattr(self, "_scan"):
            self._n_words()
        self._of_words = tx.span_hashes(self.data, self._scan.start, self._scan.end)
        return np.zeros(len(self.offsets) - 1, np.int64)

    def _hashed_words(self):
        if not hasattr(self, "_of_words"):
            self._hashes()
        return self._scan, self._of_words

    def _stutter(self):
        """Words equal to the word before them in the same text."""
        scan, hashes = self._hashed_words()
        same = np.zeros(len(hashes), bool)
        same[1:] = hashes[1:] == hashes[:-1]
        same[scan.first[:-1][scan.per_text > 0]] = False
        return np.bincount(scan.text_of()[same], minlength=len(self.offsets) - 1).astype(np.int64)

    def _n_repeat_words(self):
        scan, hashes = self._hashed_words()
        at, gram = tx.grams(hashes, scan.first, WINDOW)
        text = scan.text_of()
        key = gram ^ tx.mix(text[at].astype(np.uint64) + np.uint64(1))
        order = np.argsort(key, kind="stable")
        key, at = key[order], at[order]
        same = key[1:] == key[:-1]
        twice = np.zeros(len(key), bool)
        twice[1:] |= same
        twice[:-1] |= same
        mark = np.zeros(len(hashes) + 1, np.int64)
        np.add.at(mark, at[twice], 1)
        np.add.at(mark, at[twice] + WINDOW, -1)
        return np.bincount(text[np.cumsum(mark)[:-1] > 0], minlength=len(self.offsets) - 1).astype(np.int64)


@dataclass(frozen=True)
class Rule:
    """rejects(slice) says of each text whether the rule rejects it, by the features that it needs."""

    name: str
    needs: tuple[str, ...]
    rejects: Callable[[Slice], np.ndarray]


def rules(symbols: int = 25, capitals: int = 50, mean_word: tuple[int, int] = (2, 12), dup_lines: int = 50, stutter: int = 30) -> list[Rule]:
    """The rules of the cascade. Thresholds are per cent of words, letters or lines, and characters of a mean word."""
    low, high = mean_word
    return [
        Rule("few_words", ("n_words",), lambda s: s.get("n_words") < MIN_WORDS),
        Rule("symbols", ("n_words", "n_symbols"), lambda s: 100 * s.get("n_symbols") > symbols * s.get("n_words")),
        Rule("capitals", ("upper", "letters"), lambda s: 100 * s.get("upper") > capitals * s.get("letters")),
        Rule("mean_word", ("n_words", "word_chars"), lambda s: (s.get("word_chars") < low * s.get("n_words")) | (s.get("word_chars") > high * s.get("n_words"))),
        Rule("lines_again", ("n_lines", "n_dup_lines"), lambda s: 100 * s.get("n_dup_lines") > dup_lines * s.get("n_lines")),
        Rule("stutter", ("n_words", "hashes", "stutter"), lambda s: 100 * s.get("stutter") > stutter * s.get("n_words")),
        Rule("windows_again", ("n_words", "hashes", "n_repeat_words"), lambda s: 100 * s.get("n_repeat_words") > REPEAT_PERCENT * s.get("n_words")),
    ]


def plan(sample: Slice, chosen: list[Rule], known: tuple[str, ...] = ()) -> list[Rule]:
    """Rules in the order to run them; known: features that are there already, which cost nothing."""
    cost: dict[str, float] = dict.fromkeys(known, 0.0)
    for name in [n for rule in chosen for n in rule.needs]:
        if name not in cost:
            began = time.perf_counter()
            sample.get(name)
            cost[name] = time.perf_counter() - began
    rejected = {rule.name: rule.rejects(sample) for rule in chosen}
    left, order, alive = list(chosen), [], np.ones(len(sample.offsets) - 1, bool)
    while left:
        price = {r.name: max(1e-9, sum(cost[n] for n in r.needs)) for r in left}
        best = max(left, key=lambda r: ((rejected[r.name] & alive).sum() / price[r.name], -price[r.name]))
        left.remove(best)
        order.append(best)
        alive &= ~rejected[best.name]
        cost |= dict.fromkeys(best.needs, 0.0)
    return order


def cascade(part: Slice, order: list[Rule]) -> np.ndarray:
    """Which texts no rule rejects; a rule is evaluated only on texts that are still in."""
    alive = np.arange(len(part.offsets) - 1)
    for rule in order:
        if not len(alive):
            break
        part_alive = part.only(alive)
        alive = alive[~rule.rejects(part_alive)]
    kept = np.zeros(len(part.offsets) - 1, bool)
    kept[alive] = True
    return kept


def _with_columns(batch: pa.RecordBatch, new: dict[str, pa.Array]) -> pa.RecordBatch:
    names = [n for n in batch.schema.names if n not in new]
    return pa.RecordBatch.from_arrays([batch.column(n) for n in names] + list(new.values()), names=names + list(new))


def _schema(docs: DataFrame, new: dict[str, str]) -> str:
    kept = [f for f in docs.schema.fields if f.name not in new]
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"`{k}` {v}" for k, v in new.items()])


def assess(docs: DataFrame, text: str = "text", order: list[Rule] | None = None, counts: bool = True, chosen: list[Rule] | None = None) -> DataFrame:
    """docs with kept boolean, and with counts also COUNTS and base_failed, for every row. No shuffle.

    The counts are wanted for all rows, so they are then computed before the cascade, which reuses them; without
    counts the cascade alone runs and computes only what its rules ask for. order, if given, is taken as it is.
    """
    chosen = rules() if chosen is None else chosen
    new = ({c: "bigint" for c in COUNTS} | {"base_failed": "boolean"} if counts else {}) | {"kept": "boolean"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = order
        for batch in batches:
            for rows in tx.slices(batch, text):
                part = Slice(*tx.text_bytes(rows.column(text)))
                out: dict[str, pa.Array] = {}
                if counts:
                    values = {c: part.get(c) for c in COUNTS}
                    out |= {c: pa.array(v, pa.int64()) for c, v in values.items()}
                    out["base_failed"] = pa.array((values["n_words"] < MIN_WORDS) | (100 * values["n_repeat_words"] > REPEAT_PERCENT * values["n_words"]))
                own = plan(part, chosen, (*COUNTS, "n_lines", "hashes") if counts else ()) if own is None else own
                out["kept"] = pa.array(cascade(part, own))
                yield _with_columns(rows, out)

    return docs.mapInArrow(run, _schema(docs, new))


def keep_good(docs: DataFrame, text: str = "text", order: list[Rule] | None = None, chosen: list[Rule] | None = None) -> DataFrame:
    """The rows of docs that the cascade keeps, with the columns of docs."""
    chosen = rules() if chosen is None else chosen

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = order
        for batch in batches:
            for rows in tx.slices(batch, text):
                part = Slice(*tx.text_bytes(rows.column(text)))
                own = plan(part, chosen) if own is None else own
                yield rows.filter(pa.array(cascade(part, own)))

    return docs.mapInArrow(run, docs.schema)
