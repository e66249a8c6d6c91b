from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from tokenizers import Tokenizer

from sparkloom.llm import byte_bpe, decontaminate, quality, repeated_text, token_counts, token_files, tokenizing
from sparkloom.llm._shared import fresh_path
from sparkloom.llm.queries import BYTE_BPE, WORD_BPE

from .fixtures import frame, item_words, prose, texts


def pairs(rows):
    return sorted(rows, key=repr)


# Quality rules


def counted(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    at = {}
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i : i + 8]), []).append(i)
    again = {j for p in at.values() if len(p) > 1 for i in p for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(again)


def test_quality_counts_and_verdict(spark):
    made = quality.assess(frame(spark)).collect()
    expected = pairs((k, *counted(t or "")) for k, t in texts())
    assert pairs((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in made) == expected
    for r in made:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_quality_order_changes_no_verdict(spark):
    docs = frame(spark)
    one, other = quality.rules(), quality.rules()[::-1]
    verdicts = [pairs((r.doc_id, r.kept) for r in quality.assess(docs, order=o, counts=False).collect()) for o in (one, other)]
    assert verdicts[0] == verdicts[1]
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(k for k, good in verdicts[0] if good)


def slice_of(rows):
    raw = [t.encode() for t in rows]
    return quality.Slice(np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(r) for r in raw])).astype(np.int64))


def test_quality_puts_the_rule_that_pays_first(spark):
    sample = ["### $$$ " * 30 + str(i) for i in range(50)] + [prose(i, 60) for i in range(50)]
    order = [r.name for r in quality.plan(slice_of(sample), quality.rules())]
    assert sorted(order) == sorted(r.name for r in quality.rules()) and order[0] in ("symbols", "stutter", "windows_again")
    # What the first rule has rejected or computed doesn't count again: rules that reject nothing more come by their cost.
    slow = quality.Rule("slow", ("n_repeat_words",), lambda s: np.zeros(len(s.offsets) - 1, bool))
    quick = quality.Rule("quick", ("n_words",), lambda s: np.zeros(len(s.offsets) - 1, bool))
    assert [r.name for r in quality.plan(slice_of(sample), [slow, quick])] == ["quick", "slow"]
    assert [r.name for r in quality.plan(slice_of([]), quality.rules())]
    assert quality.assess(frame(spark).limit(0)).count() == 0 and quality.keep_good(frame(spark).limit(0)).count() == 0


def test_quality_cascade_sees_only_what_is_left():
    seen = []

    def rule(name, rejects):
        return quality.Rule(name, (), lambda s: (seen.append((name, len(s.offsets) - 1)), rejects(s))[1])

    part = slice_of(["a b"] * 6 + [prose(1, 30)] * 4)
    kept = quality.cascade(part, [rule("few", lambda s: s.get("n_words") < 20), rule("none", lambda s: s.get("n_words") < 0)])
    assert kept.sum() == 4 and seen == [("few", 10), ("none", 4)]


# Decontamination


def searched(t, windows):
    w = item_words(t)
    hit, items = set(), set()
    for x, owners in windows.items():
        for k in range(len(w) - len(x) + 1):
            if tuple(w[k : k + len(x)]) == x:
                hit.update(range(k, k + len(x)))
                items |= owners
    return len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block_bytes", [8 << 20, 100])
def test_decontamination(spark, block_bytes):
    items = [(1, prose(5, 20_000)[:300]), (2, prose(1, 60)), (3, "different"), (4, None), (5, " .. "), (6, "ONE two"), (6, "ONE two"), (11, prose(4, 12)), (None, "x" * 500)]
    windows = {}
    for i, t in items:
        w = item_words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add("" if i is None else str(i))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    made = decontaminate.find_contamination(frame(spark), bench, block_bytes=block_bytes).collect()
    assert pairs((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in made) == pairs((k, *searched(t, windows)) for k, t in texts())


def test_decontamination_by_blocks_runs_one_pass_at_a_time(spark, monkeypatch):
    """Each block is a job of its own, whose stages have one Python node, and results are those of one block."""
    items = [(i, prose(200 + i, 14)) for i in range(12)]
    docs = frame(spark, [(i, prose(200 + i % 12, 14) + " " + prose(300 + i, 30)) for i in range(20)] + [(20, None), (21, prose(400, 40))])
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    loaded = []
    monkeypatch.setattr(decontaminate, "_deal", lambda *a, f=decontaminate._deal: loaded.append(f(*a)) or loaded[-1])
    many, one = (decontaminate.find_contamination(docs, bench, block_bytes=size) for size in (400, 1 << 20))
    assert loaded[0] >= 3 and loaded[1] == 1
    columns = ["doc_id", *decontaminate.RESULT]
    assert pairs(map(tuple, many.select(columns).collect())) == pairs(map(tuple, one.select(columns).collect()))
    assert many.columns == one.columns and "MapInArrow" not in many._jdf.queryExecution().optimizedPlan().toString()
    clean = decontaminate.drop_contaminated(docs, bench, block_bytes=400)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {20, 21}


def test_decontamination_of_nothing(spark):
    docs, none = frame(spark), spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.find_contamination(docs, none).where("contaminated").count() == 0
    assert decontaminate.drop_contaminated(docs, none).columns == docs.columns
    assert decontaminate.find_contamination(docs.limit(0), none).count() == 0


# Repeated text


def covered(rows):
    count = Counter(t[p : p + 200] for t in rows for p in range(len(t) - 199))
    out = []
    for t in rows:
        mark = bytearray(len(t))
        for p in range(len(t) - 199):
            if count[t[p : p + 200]] > 1:
                mark[p : p + 200] = b"\1" * 200
        kept = bytes(b for b, x in zip(t, mark, strict=True) if not x)
        out.append((len(t), sum(mark), len(re.findall(rb"\x01+", bytes(mark))), kept))
    return out


@pytest.mark.parametrize("max_contexts", [4096, 1])
def test_repeated_text(spark, max_contexts):
    rows = texts() + [(20, prose(30, 3000)), (21, prose(31, 100) + prose(30, 3000)[2000:9000] + prose(32, 40)), (22, "ab" * 400), (23, prose(33, 30) + prose(5, 20_000)[40_000:90_000])]
    made = repeated_text.report(frame(spark, rows), max_contexts=max_contexts).collect()
    expected = covered([(t or "").encode() for _, t in rows])
    assert pairs((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in made) == pairs((k, *e) for (k, _), e in zip(rows, expected, strict=True))


def test_rows_without_ids_keep_their_own_spans(spark):
    shared = prose(34, 100)
    rows = [(None, shared + " " + prose(100 + i, 60)) if i % 2 else (None, prose(100 + i, 160)) for i in range(600)]
    made = repeated_text.report(frame(spark, rows)).collect()
    expected = covered([t.encode() for _, t in rows])
    assert pairs((r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in made) == pairs(expected)
    keys = [repeated_text.row_key(k, t) for k in (None, 1, 2) for t in (b"a", b"b")]
    assert len(set(keys)) == 6 and repeated_text.row_key(1, b"a") == keys[2]


def test_repeated_text_in_pieces(monkeypatch):
    import sparkloom.llm.repeated_text as module

    long = (prose(40, 700) + " " + prose(41, 100) + " " + prose(40, 700)).encode()
    data = np.frombuffer(b"x" * 300 + long + b"yy" + long, np.uint8)
    offsets = np.cumsum([0, 300, len(long), 2, len(long)])
    monkeypatch.setattr(module, "PIECE", 1000)
    seen, parts = {}, 0
    for part, places, row, base in module._pieces(data, offsets):
        parts += 1
        assert len(part) <= 1200
        found = module.Occurrences(part, places)
        for t, low, high in zip(found.text, found.low, found.high, strict=True):
            seen.setdefault(int(row[t]), set()).update(int(base[t] + w - places[t]) for w in range(low, high + 1))
    assert parts > 6 and seen == {0: set(range(101)), 1: set(range(len(long) - 199)), 3: set(range(len(long) - 199))}


def test_repeated_text_keeps_columns(spark):
    docs = frame(spark)
    made = repeated_text.remove(docs)
    assert made.columns == docs.columns and made.count() == docs.count()
    assert all("�" not in r.text for r in made.collect())
    assert repeated_text.report(docs.limit(0)).count() == 0


# Tokens


@pytest.mark.parametrize("style", ["words", "higher_order"])
def test_byte_bpe(spark, style):
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(BYTE_BPE), special_tokens={})
    docs = frame(spark)
    made = byte_bpe.decode(byte_bpe.encode(docs, BYTE_BPE, public_tokenizers.PATTERN, style=style, batch_bytes=5000), BYTE_BPE).collect()
    assert pairs((r.doc_id, np.frombuffer(r.ids, "<u4").tolist(), bytes(r.decoded).decode()) for r in made) == pairs((k, own.encode_ordinary(t or ""), t or "") for k, t in texts())
    assert byte_bpe.encode(docs.limit(0), BYTE_BPE, public_tokenizers.PATTERN, style=style).count() == 0


def test_pattern_knows_letters_as_the_library_does():
    """Every code point, before and after letters, numbers, spaces and signs."""
    find = byte_bpe.finder(public_tokenizers.PATTERN)
    classes = {}
    for cls, sample in ((r"\p{L}", "a"), (r"\p{N}", "1")):
        library = tiktoken.Encoding("x", pat_str=cls, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        points = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF)
        classes[sample] = set(bytes(library.encode_ordinary(points)).decode())
    for c in map(chr, range(0x80, 0x110000)):
        if "\ud800" <= c <= "\udfff":
            continue
        for sample, members in classes.items():
            assert (find(sample + c) == [sample + c]) == (c in members), hex(ord(c))
    draw = random.Random(8)
    folder = byte_bpe._WordFolder(BYTE_BPE, public_tokenizers.PATTERN)
    real = tiktoken.Encoding("real", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(BYTE_BPE), special_tokens={})
    odd = [chr(c) for c in range(0x80, 0x40000) if regex.match(f"[{byte_bpe.NEWER_LETTERS}{byte_bpe.NEWER_NUMBERS}]", chr(c))]
    for _ in range(3000):
        text = "".join(draw.choice(["a", "1", " ", "\n", "!", "'s", draw.choice(odd), draw.choice(odd), "é"]) for _ in range(8))
        assert np.frombuffer(folder.text(text), "<u4").tolist() == real.encode_ordinary(text)


def test_words_of_a_slice_are_folded_together(monkeypatch):
    """As one by one and as the library, for words of all lengths, few of which are folded alone, and with little kept."""
    draw = random.Random(11)
    letters = ["a", "e", "th", "er", "x", "Q", "7", "42", "é", "字", "😀", "-", "'s", "!!"]
    words = ["".join(draw.choice(letters) for _ in range(draw.choice([1, 3, 6, 10, 40]))) for _ in range(6000)]
    rows = [draw.choice(["", "\n", " "]) * (i % 9 == 0) + "".join(w + draw.choice([" ", " ", "\n"]) for w in words[i : i + 30])[: -(i % 8 > 0) or None] for i in range(0, 6000, 30)]
    rows += ["", " ", "\n", "a", "a\x1cb c", "z" * 5000 + " end", " ".join(["word"] * 300), "tab\there"]
    real = tiktoken.Encoding("real", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(BYTE_BPE), special_tokens={})
    alone = []
    fold_word = byte_bpe.fold_word
    monkeypatch.setattr(byte_bpe, "fold_word", lambda w, ranks: (alone.append(w), fold_word(w, ranks))[1])
    for kept in (200_000, 50):
        monkeypatch.setattr(byte_bpe, "KEPT_PIECES", kept)
        folder = byte_bpe._WordFolder(BYTE_BPE, public_tokenizers.PATTERN)
        made = [ids for i in range(0, len(rows), 40) for ids in folder.texts(rows[i : i + 40])]
        assert [np.frombuffer(x, "<u4").tolist() for x in made] == [real.encode_ordinary(t) for t in rows]
        assert len(folder.known) < 20_000 and not any(len(p) > 64 for p in [*folder.known, *folder.first])
    assert len(alone) < 6000
    ids = [[byte_bpe.load_ranks(BYTE_BPE)[bytes([b])] for b in w.encode()] for w in words if len(w.encode()) == 12]
    made = byte_bpe.fold_rows(np.array(ids), BYTE_BPE)
    fill = len(byte_bpe.pair_arrays(BYTE_BPE)[0]) - 1
    assert [[x for x in r if x != fill] for r in made.tolist()] == [fold_word(w.encode(), byte_bpe.load_ranks(BYTE_BPE)) for w in words if len(w.encode()) == 12]


@pytest.fixture(scope="module")
def library_ids():
    own = Tokenizer.from_file(WORD_BPE)
    return [(k, t or "", own.encode(t or "", add_special_tokens=False).ids) for k, t in texts()]


def test_forms_of_a_word_are_asked_for_once(monkeypatch):
    """Ids are the library's for words of all kinds; small and capital letters, commas and full stops need no question."""
    own = Tokenizer.from_file(WORD_BPE)
    draw = random.Random(12)
    letters = ["a", "B", "th", "ER", "é", "É", "ß", "ÿ", "Þ", "÷", "×", "ª", "e\u0301", "İ", "ſ", "字", "7", "'", "'s", "-", "%%", ",", ".", "<|endoftext|>", "\x01", "\xa0"]
    plain, common = letters[:9], letters[:3]
    rows = [" ".join("".join(draw.choice(draw.choice([letters, plain, common])) for _ in range(draw.choice([1, 2, 5, 40]))) + draw.choice(["", ",", ".", ",.", "..", ".'s"]) for _ in range(60)) for _ in range(60)]
    monkeypatch.setattr(tokenizing, "GROUP", 50)
    for kept in (500_000, 20):
        monkeypatch.setattr(tokenizing, "CACHED_WORDS", kept)
        made = tokenizing.JsonTokenizer(WORD_BPE)
        for i in range(0, 60, 10):
            assert [np.frombuffer(x, "<u4").tolist() for x in made.encode([t.encode() for t in rows[i : i + 10]])] == [e.ids for e in own.encode_batch(rows[i : i + 10], add_special_tokens=False)]
    made = tokenizing.JsonTokenizer(WORD_BPE)
    made.encode([b"strange"])
    monkeypatch.setattr(tokenizing.JsonTokenizer, "_cut", None)
    assert np.frombuffer(made.encode([b"Strange strange, STRANGE. strange."])[0], "<u4").tolist() == own.encode("Strange strange, STRANGE. strange.", add_special_tokens=False).ids


def test_token_counts_and_their_cache(spark, library_ids):
    cache = fresh_path(spark, "cache")
    expected = pairs((k, len(t.encode()), len(i), len(i) > 2048) for k, t, i in library_ids)
    for _ in range(2):
        made = token_counts.count_tokens(frame(spark), WORD_BPE, cache)
        assert pairs(map(tuple, made.collect())) == expected
    stored = spark.read.parquet(cache)
    assert stored.groupBy("version", "digest").count().where("count > 1").count() <= 1
    assert token_counts.count_tokens(frame(spark, [(99, "one\ttwo\nthree")]), WORD_BPE, cache).first().n_tokens == 3
    assert spark.read.parquet(cache).count() == stored.count()
    assert token_counts.count_tokens(frame(spark).limit(0), WORD_BPE, cache).count() == 0


@pytest.mark.parametrize("few", [0, 200_000])
def test_only_distinct_misses_are_encoded(spark, monkeypatch, few):
    monkeypatch.setattr(token_counts, "BROADCAST_ROWS", few)
    cache = fresh_path(spark, "cache")
    docs = frame(spark, [(None, "one text")] * 5 + [(1, "one text"), (1, "one text"), (2, "another"), (3, None), (4, "")]).selectExpr("*", "1 AS _key", "2 AS n_bytes", "3 AS digest")
    assert token_counts.count_tokens(docs.where("doc_id = 2"), WORD_BPE, cache).count() == 1
    made = token_counts.count_tokens(docs, WORD_BPE, cache)
    assert made.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"] and made.count() == 10
    assert sorted(r.n_tokens for r in spark.read.parquet(cache).collect()) == [0, 1, 2]


def test_token_counts_of_pieces(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    own = sentencepiece.SentencePieceProcessor(model_file=path)
    made = token_counts.count_tokens(frame(spark), path)
    assert pairs((r.doc_id, r.n_tokens) for r in made.collect()) == pairs((k, len(own.encode(t or ""))) for k, t in texts())


@pytest.mark.parametrize("file_bytes", [200, 8 << 20])
def test_token_files(spark, library_ids, file_bytes):
    docs = frame(spark).selectExpr("*", "1 AS shard", "2 AS offset", "3 AS place")
    written = token_files.write(docs, fresh_path(spark, "ids"), WORD_BPE, shard_bytes=4000, file_bytes=file_bytes)
    index = token_files.read_index(spark, written)
    back = token_files.read_documents(index, written).collect()
    found = sorted(back, key=lambda r: r.start)
    assert [r.start for r in found] == np.cumsum([0] + [len(r.ids) // 4 for r in found])[:-1].tolist()
    keys = [r.doc_id for r in found]
    assert keys == sorted(keys, key=lambda k: (k is not None, k))
    assert pairs((r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in back) == pairs((k, [*i, 1]) for k, _, i in library_ids)
    assert index.select("shard").distinct().count() > 3 and index.select("file").distinct().count() >= index.select("shard").distinct().count()
    one = token_files.read_documents(index.where("doc_id = 4"), written).collect()
    assert len(one) == 1 and one[0].start == next(r.start for r in found if r.doc_id == 4)
    with pytest.raises(Exception, match="dictionary"):
        token_files.read_documents(index, token_files.Dataset(written.path, "0" * 64)).collect()


def test_frames_use_a_trained_dictionary(spark):
    """Many short documents: the dictionary is trained, frames need it, and they are smaller by it."""
    rows = [(i, prose(5000 + i, 60)) for i in range(400)]
    written = token_files.write(frame(spark, rows), fresh_path(spark, "ids"), WORD_BPE)
    with open(written.path.removeprefix("file://") + "/dictionary", "rb") as f:
        dictionary = f.read()
    assert len(dictionary) > 1000 and dictionary[:4] == b"\x37\xa4\x30\xec"
    own = Tokenizer.from_file(WORD_BPE)
    back = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in token_files.read_documents(token_files.read_index(spark, written), written).collect()}
    assert back == {k: [*own.encode(t, add_special_tokens=False).ids, 1] for k, t in rows}
    raw = np.array(back[0], "<u2").tobytes()
    plain, shared = (token_files._compressor(d).compress(raw) for d in (b"", dictionary))
    assert len(shared) < len(plain)
    with pytest.raises(Exception):
        token_files._decompressor(b"").decompress(shared)


def test_one_key_may_fill_several_shards(spark):
    rows = [(7, prose(6000 + i, 40)) for i in range(120)] + [(i, prose(7000 + i, 40)) for i in range(20)] + [(None, "x"), (None, "y")]
    written = token_files.write(frame(spark, rows), fresh_path(spark, "ids"), WORD_BPE, shard_bytes=1000)
    index = token_files.read_index(spark, written)
    assert index.where("doc_id = 7").select("shard").distinct().count() > 3
    back = sorted(token_files.read_documents(index, written).collect(), key=lambda r: r.start)
    assert [r.start for r in back] == np.cumsum([0] + [len(r.ids) // 4 for r in back])[:-1].tolist()
    assert [r.doc_id for r in back] == sorted((k for k, _ in rows), key=lambda k: (k is not None, k))


def test_token_files_of_nothing(spark):
    written = token_files.write(frame(spark).limit(0), fresh_path(spark, "ids"), WORD_BPE)
    assert token_files.read_index(spark, written).count() == 0
