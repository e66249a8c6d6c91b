"""The pipeline against a brute-force version of its five stages."""

from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline
from sparkloom.llm import byte_bpe
from sparkloom.llm.queries import BYTE_BPE

from .fixtures import frame, item_words, prose, texts
from .test_other_operators import brute_kept, near_rows
from .test_text_operators import counted, covered, searched


def good(t):
    n, chars, symbols, dup, again = counted(t)
    words = t.split()
    lines = [x for x in t.split("\n") if x.split()]
    upper, letters = sum("A" <= c <= "Z" for c in t), sum(c.isascii() and c.isalpha() for c in t)
    stutter = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return not (n < 20 or 100 * again > 30 * n or 100 * symbols > 25 * n or 100 * upper > 50 * letters or not 2 * n <= chars <= 12 * n or 2 * dup > len(lines) or 100 * stutter > 30 * n)


def test_pipeline(spark, tmp_path):
    rows = [r for r in near_rows() if r[0] is not None] + [(None, prose(67, 60)), (200, prose(60, 80)), (201, prose(61, 30) + " " + prose(62, 40)), (202, prose(63, 30) + " " + prose(62, 60)), (203, "### $$$ %%% word " * 30), (204, prose(64, 40).upper())]
    items = [(1, prose(60, 80)[100:260]), (2, "nothing of this is anywhere in the documents that we have here")]
    docs = frame(spark, rows).withColumn("lang", __import__("pyspark.sql.functions", fromlist=["lit"]).lit("en")).drop("n_words", "kept", "rid")
    docs.selectExpr("*", "cast(length(text) as bigint) AS n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    left = [(k, t or "") for k, t in rows if good(t or "")]
    left = brute_kept(left)
    left = [(k, kept.decode(errors="ignore")) for (k, _), (_, _, _, kept) in zip(left, covered([t.encode() for _, t in left]), strict=True)]
    windows = {}
    for i, t in items:
        w = item_words(t)
        for j in range(len(w) - 9):
            windows.setdefault(tuple(w[j : j + 10]), set()).add(str(i))
    left = [(k, t) for k, t in left if not searched(t, windows)[4]]
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(BYTE_BPE), special_tokens={})
    expected = []
    for k, t in left:
        ids = own.encode_ordinary(t)
        expected.append((k, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))

    made = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, made.collect()), key=repr) == sorted(expected, key=repr)
    assert len(expected) > 5 and 200 not in {k for k, *_ in expected}


def test_pipeline_of_nulls_long_texts_repeated_rows_and_nothing(spark, tmp_path):
    """Rows through all stages: ids and texts that are null, a very long text, rows alike, and clashing columns."""
    rows = texts() + [(None, prose(65, 50)), (None, prose(65, 50)), (30, prose(66, 40_000)), (31, None)]
    docs = frame(spark, rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, None), (None, prose(66, 40_000)[5000:5100])], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    ids = [r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    left = [(k, t or "") for k, t in rows if good(t or "")]
    expected = [k for k, t in brute_kept(left) if k != 30]
    assert sorted(ids, key=repr) == sorted(expected, key=repr) and None in ids and 30 not in ids and 10 in ids
    assert corpus_pipeline.byte_level_bpe(spark, docs.limit(0), str(tmp_path)).count() == 0
