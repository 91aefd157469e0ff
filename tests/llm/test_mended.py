"""Cases that earlier versions of the operators got wrong."""

from __future__ import annotations

import random
import time

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from webstrata.llm import automaton, dedup, extraction, language, neighbours

DOCS = "doc_id long, text string"


@pytest.mark.parametrize("copies", [30, 200])
def test_a_repeated_query_id_does_not_starve_its_candidates(spark, copies):
    rng = np.random.default_rng(1)
    vectors = [(20, rng.normal(size=16).tolist()) for _ in range(copies)] + [(1000 + 2 * k + 1, rng.normal(size=16).tolist()) for k in range(30)]
    got = neighbours.search(spark.createDataFrame(vectors, "vec_id long, embedding array<double>")).toPandas()
    asked = np.array(min(v for i, v in vectors if i == 20))
    want = sorted((-float(neighbours.exact_scores(np.array([v]), asked)[0]), i) for i, v in vectors if i != 20)
    assert got["rank"].tolist() == list(range(1, 21)) and len({i for i in got.vec_id} & {i for _, i in want[:20]}) >= 18


def test_bpe_takes_letters_and_numbers_as_the_library_does():
    path = public_tokenizers.path("word_bpe_49k.json")
    tok, encoder = Tokenizer.from_file(path), automaton.TextEncoder(path)
    tok.no_truncation()
    tok.no_padding()
    points = [c for c in [*range(1, 0xD800), *range(0xE000, 0x32000), *range(0xE0000, 0xE0200)]]
    texts = [" ".join(f"a{c}b #{c}# {c}{c}1" for c in map(chr, points[at : at + 256])) for at in range(0, len(points), 256)]
    rng = random.Random(3)
    odd = [chr(c) for c in (0x208F, 0x209D, 0x209E, 0x209F, 0x558, 0x10D50)] + list("aZ19 .,-'éßΣ漢ｱ́½Ⅳ\n🙂")
    texts += ["".join(rng.choice(odd) for _ in range(rng.randint(1, 40))) for _ in range(4000)]
    for text, got, want in zip(texts, encoder.encode(texts), tok.encode_batch(texts, add_special_tokens=False), strict=True):
        assert got[1] == " ".join(map(str, want.ids)), text[:100]


def test_rows_that_share_a_hash_are_not_taken_for_repeats(spark, monkeypatch):
    """With a first hash of three values nearly all rows share one; no text may be lost."""
    rng = random.Random(4)
    rows = [(k, " ".join(f"w{rng.randrange(900)}" for _ in range(40))) for k in range(60)]
    own = F.xxhash64
    monkeypatch.setattr(dedup.F, "xxhash64", lambda *cols: F.pmod(own(*cols), F.lit(3)) if cols and isinstance(cols[0], str) and cols[0] == "doc_id" else own(*cols))
    kept = dedup.keep_one(spark.createDataFrame([*rows, rows[5], rows[5]], DOCS)).collect()
    assert sorted(map(tuple, kept)) == rows


def test_names_of_containers_go_through_the_threshold(spark, sf):
    """On the given pages nothing is dropped ahead of it but navigation and the like: without a threshold menus and comments stay."""
    pages = [r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    assert sum(extraction.main_text(p, share=0.0) != extraction.main_text(p) for p in pages) > 0.9 * len(pages)


def test_parsings_that_never_meet_take_linear_time():
    parser = language.CrossParser({"a": "abc é " * 3 + "aaa abé", "b": "the cat ééé", "c": "aé" * 9})
    rng = random.Random(5)
    texts = ["a" * 5000, "ab" * 4000, "the " * 3000, "x", "", "aaaa" * 2000 + "b" + "a" * 3000, "é" * 4000, "aé" * 3000]
    texts += ["".join(rng.choice("abé ") for _ in range(rng.randint(1, 6000))) for _ in range(30)]
    for text, got in zip(texts, parser.phrases(texts)[0].tolist(), strict=True):
        codes = parser.alphabet.codes(text).tolist()
        assert got == [a.walk(0, codes, [False] * len(codes))[0] + 1 if codes else 0 for a in parser.automata]
    began = time.process_time()
    parser.phrases(["a" * 1_000_000])
    assert time.process_time() - began < 4


def test_hubs_that_meet_their_pairs_in_parts(spark, monkeypatch):
    """Buckets of many near copies, in parts of two: the same components as in one part."""
    rng = random.Random(6)
    words = [f"w{k}" for k in range(400)]
    base = [rng.choice(words) for _ in range(120)]
    rows = [(k, " ".join([*base[:100], *[rng.choice(words) for _ in range(k % 3)], *base[100:]])) for k in range(40)]
    rows += [(100 + k, " ".join(rng.choice(words) for _ in range(60))) for k in range(20)]
    docs = spark.createDataFrame(rows, DOCS)
    whole = sorted(map(tuple, dedup.near_duplicates(docs).collect()))
    monkeypatch.setattr(dedup, "PART", 2)
    assert sorted(map(tuple, dedup.near_duplicates(docs).collect())) == whole and sum(r[2] == 0 for r in whole) >= 40


def test_a_block_is_indexed_once_and_copies_are_dealt_over_blocks(spark, monkeypatch):
    """Batches that cut blocks and queries anywhere give the same rows; copies of one row fill no block."""
    rng = np.random.default_rng(31)
    hot = rng.standard_normal(8).tolist()
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(300)] + [(7, hot)] * 150
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    whole = neighbours.search(frame).toPandas()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        cut = neighbours.search(frame, most_tasks=1).toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    order = ["query_id", "rank"]
    assert whole.sort_values(order).reset_index(drop=True).equals(cut.sort_values(order).reset_index(drop=True))
    assert (whole.groupby("query_id").size() == 20).all()
    coder = neighbours.learn_coder(np.array([r[1] for r in rows]), len(rows))
    index = neighbours.index_vectors(neighbours.usable_vectors(frame, "vec_id", "embedding"), coder)
    blocks = index.filter("vec_id = 7").selectExpr("pmod(xxhash64(slot), 4) AS block").groupBy("block").count().toPandas()
    assert len(blocks) == 4 and blocks["count"].max() < 80 and index.select("slot").distinct().count() == len(rows)
