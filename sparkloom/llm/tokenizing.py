"""Task-side use of public tokenizer files through their libraries, with a bounded cache of encoded words.

A ``tokenizers`` file whose normaliser and splitter treat white space as a mere separator encodes a text as it would
encode the text's words one after another. Words repeat, so a worker process keeps each word's ids and asks the library
only for new words. A word of Latin letters is asked for in small letters and without a comma or full stop at its end, which is
a token of its own, so that one question does for all its forms; normaliser and splitter leave it as it is, so the library's
model is asked directly. Any other file is used on whole texts.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from array import array
from collections.abc import Callable
from itertools import islice
from typing import Any

import numpy as np

#: The normaliser and splitter of files that drop white space between words.
WHITE_SPACE_DROPPED = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}

CACHED_WORDS = 500_000
CACHED_LENGTH = 64
#: A control character that is no word of any text, as words that have it count among the long ones.
MARK = "\x01"
#: Words are asked for in groups of so many.
GROUP = 1000
#: Lines of letters of ASCII and Latin-1 in UTF-8, and one comma or full stop at most.
_LATIN = re.compile(rb"^(?=[A-Za-z\xc3])[A-Za-z]*(?:\xc3[\x80-\x96\x98-\xb6\xb8-\xbf][A-Za-z]*)*[.,]?$", re.M).findall
_ENDS = (b",", b".")
#: Characters that stand for bytes in byte-level files: themselves if they are visible, and others from 256 on.
_VISIBLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTE_CHARACTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _VISIBLE)} | {0x20: 0x20}


class JsonTokenizer:
    """A file of the tokenizers library; ids come as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        with open(path, encoding="utf-8") as f:
            text = f.read()
        made = json.loads(text)
        self.tokenizer = Tokenizer.from_str(text)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.by_word = all(made.get(k) == v for k, v in WHITE_SPACE_DROPPED.items()) and not any(
            a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"] or any(c.isspace() for c in a["content"]) for a in made["added_tokens"]
        )
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self.model = None
        if self.by_word and self.mark is not None and all(any(not c.isalpha() and c not in ",." for c in a["content"]) for a in made["added_tokens"]):
            self.model = Tokenizer(self.tokenizer.model)
            self.model.pre_tokenizer = WhitespaceSplit()
            self.ends = dict(zip((e[0] for e in _ENDS), self._ask([e.decode() for e in _ENDS]), strict=True))
        self.known: dict[bytes, bytes] = {}

    def _ask(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _ask_words(self, words: list[bytes]) -> list[bytes]:
        """As _ask, for short words: many go in one text, with a mark between them that none of them has."""
        if self.mark is None:
            return self._ask([w.decode() for w in words])
        return self._cut(self.tokenizer, f" {MARK} ".join([w.decode() for w in words]), words)

    def _ask_latin(self, words: list[bytes]) -> list[bytes]:
        """As _ask_words, for Latin letters, all small."""
        text = f" {MARK} ".encode().join(words)
        text = text.decode().replace(MARK, chr(_BYTE_CHARACTERS[1])) if text.isascii() else text.decode("latin-1").translate(_BYTE_CHARACTERS)
        return self._cut(self.model, text, words)

    def _cut(self, asked: Any, text: str, words: list[bytes]) -> list[bytes]:
        ids = np.array(asked.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        ends = np.append(np.flatnonzero(ids == self.mark), len(ids)) * 4
        if len(ends) != len(words):
            return self._ask([w.decode() for w in words])
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *(ends[:-1] + 4).tolist()], ends.tolist(), strict=True)]

    def _learn(self, words: list[list[bytes]]) -> dict[bytes, bytes]:
        if len(self.known) > CACHED_WORDS:
            self.known = dict(islice(self.known.items(), CACHED_WORDS // 2))  # those that came first are the most frequent
        new = set().union(*words).difference(self.known)
        latin = [w for w in _LATIN(b"\n".join(new)) if len(w) <= CACHED_LENGTH] if self.model is not None else []
        if latin:
            small = b"\n".join(latin).decode().lower().encode().replace(b",", b"").replace(b".", b"").split(b"\n")
            missing = set(small).difference(self.known)
            ascii_ = {w for w in missing if w.isascii()}
            self._keep(list(ascii_), self._ask_latin)
            self._keep(list(missing - ascii_), self._ask_latin)
            known, end = self.known, self.ends.get
            known.update({w: known[s] + end(w[-1], b"") for w, s in zip(latin, small, strict=True)})
            new.difference_update(latin)
        long = {w for w in new if len(w) > CACHED_LENGTH or b"\x01" in w}  # asked for alone and not kept
        self._keep(list(new - long), self._ask_words)
        return {w: self._ask([w.decode()])[0] for w in long}

    def _keep(self, words: list[bytes], ask: Callable[[list[bytes]], list[bytes]]) -> None:
        for part in (words[i : i + GROUP] for i in range(0, len(words), GROUP)):
            self.known.update(zip(part, ask(part), strict=True))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text, which comes as UTF-8."""
        if not self.by_word:
            return [x for t in texts for x in self._ask([t.decode()])]
        words = [t.split() for t in texts]
        long = self._learn(words)
        if not long:
            get = self.known.__getitem__
            return [b"".join(map(get, w)) for w in words]
        return [b"".join([long[x] if x in long else self.known[x] for x in w]) for w in words]

    def count(self, texts: list[bytes]) -> list[int]:
        if not self.by_word:
            return [len(x) // 4 for x in self.encode(texts)]
        words = [t.split() for t in texts]
        long = self._learn(words)
        if not long:
            get = self.known.__getitem__
            return [sum(map(len, map(get, w))) // 4 for w in words]
        return [sum([len(long[x]) if x in long else len(self.known[x]) for x in w]) // 4 for w in words]


class PieceTokenizer:
    """A .model file of the sentencepiece library."""

    by_word = False

    def __init__(self, path: str):
        import sentencepiece

        self.tokenizer = sentencepiece.SentencePieceProcessor(model_file=path)
        self.vocabulary = self.tokenizer.vocab_size()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        return [array("I", self.tokenizer.encode(t.decode())).tobytes() for t in texts]

    def count(self, texts: list[bytes]) -> list[int]:
        return [len(self.tokenizer.encode(t.decode())) for t in texts]


@functools.cache
def tokenizer(path: str) -> JsonTokenizer | PieceTokenizer:
    """The tokenizer at path, loaded once per worker process."""
    return PieceTokenizer(path) if path.endswith(".model") else JsonTokenizer(path)


def version_digest(path: str, rule: str) -> str:
    """Hex digest of everything that a stored count depends on: the file, the library's version and the rule."""
    from importlib.metadata import version

    library = "sentencepiece" if path.endswith(".model") else "tokenizers"
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + f"|{library} {version(library)}|{rule}".encode()).hexdigest()
