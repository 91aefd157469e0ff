"""The corpus pipeline stage by stage, and as a whole."""

from __future__ import annotations

import numpy as np
import pytest

import corpus_pipeline as cp
from webstrata.llm import queries as llm_queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = np.random.default_rng(9)
    words = {"en": "the of and river mill boat sea tide small old wait turn again house".split(), "fr": "le la de et chat sur tapis rivière petit vieux bateau maison encore".split()}
    rows = []
    for i in range(60):
        lang = ("en", "fr")[i % 2]
        rows.append((i, " ".join(rng.choice(words[lang], 60)) + ".", lang, "s", None, "e"))
    rows[10] = (10, rows[0][1], "en", "s", None, None)
    rows[12] = (12, rows[2][1] + " token = abcdef123456", "en", None, 5, "e")
    rows += [(70, None, None, None, None, None), (71, "", "en", "s", 0, "e"), (72, "%%% " * 40, "en", "s", 160, "e"), (None, " ".join(rng.choice(words["en"], 40)), "en", "s", 3, "e"), rows[5]]
    root = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 60, 3)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return root


def test_stages_keep_columns_and_decide(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns = docs.columns
    for name, stage in cp.STAGES[:-1]:
        docs = cp.materialize(stage(spark, docs, corpus), "t")
        assert docs.columns == columns, name
    left = {r.doc_id: r for r in docs.collect()}
    assert not {10, 70, 71, 72} & left.keys() and {0, 1, 2, 5} <= left.keys() and docs.filter("doc_id = 5").count() == 1
    changed = [r for r in left.values() if r.doc_id is not None and "[SECRET]" in r.text]
    assert all("abcdef123456" not in r.text and r.n_chars == len(r.text) for r in changed)
    assert cp.run(spark, corpus).select("doc_id").distinct().count() == len(left)


def test_rows_without_or_with_shared_ids_are_documents(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 999, 40)) for _ in range(5)]
    rows = [(None, texts[0], None, "s", 1, None), (None, texts[0], None, "s", 1, None), (None, texts[0], "en", "s", 1, None), (7, texts[1], None, None, None, None), (7, texts[2], None, None, None, None), (9, texts[1] + " more", None, None, None, None)]
    rows += [(None, texts[3], None, None, None, None), (3, texts[3], None, None, None, None), (None, "", None, None, None, None), (None, None, None, None, None, None), (None, None, None, None, None, None)]
    got = cp.near_dedup(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert got.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    assert sorted((str(r.doc_id), str(r.text)) for r in got.collect()) == sorted((str(i), str(t)) for i, t in [(None, texts[0]), (7, texts[1]), (7, texts[2]), (3, texts[3]), (None, ""), (None, None)])


def test_empty_corpus(spark, corpus, tmp_path):
    spark.read.parquet(f"{corpus}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{corpus}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_registered(spark):
    names = llm_queries.queries()
    assert sorted(n.split("_")[0] for n in names if n != "pipeline") == sorted(f"op{i}" for i in range(1, 11))
    assert set(llm_queries.oracle_sql()) <= set(names)


def test_pipeline_matches_brute_force(spark, sf):
    """The whole pipeline over sf0.001 against plain Python, stage by stage."""
    import math
    import re
    import zlib

    import public_tokenizers
    from tokenizers import Tokenizer

    from tests.llm.test_operators import brute_components
    from webstrata.llm import language, quality, secrets

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    good = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1").collect()}
    raw, target = np.zeros(1 << 16), np.zeros(1 << 16)
    for i, t in docs.items():
        for g in quality.hashed_ngrams(t or "", 3, 16):
            raw[g] += 1
            target[g] += i in good
    seen = (raw > 0).sum()
    ratio = np.log((target + 1) / (target.sum() + seen)) - np.log((raw + 1) / (raw.sum() + seen))
    kept = {}
    for i, t in docs.items():
        words, _, _, _, repeated = quality.base_counts(t or "")
        grams = quality.hashed_ngrams(t or "", 3, 16)
        if words >= 20 and 100 * repeated <= 30 * words and ratio[grams].mean() >= -0.7:
            kept[i] = t
    frame = spark.read.parquet(f"{sf}/documents.parquet").filter(f"doc_id IN ({','.join(map(str, kept))})")
    parser = language.CrossParser(language.learn_samples(frame))
    kept = {i: t for (i, t), g in zip(kept.items(), parser.guess(list(kept.values())), strict=True) if g[0] != "und" and g[3] <= cp.MAX_PHRASE_RATE}
    component = brute_components(list(kept.items()))
    kept = {i: t for i, t in kept.items() if component[i][1] == i}

    def entropy(window):
        return -sum(n / len(window) * math.log2(n / len(window)) for n in map(window.count, set(window)))

    assign = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for i, t in kept.items():
        spans = [m.span() for m in assign.finditer(t) if len(m[1]) >= 6] + [m.span() for p in (secrets.ACCESS, secrets.HEX) for m in re.finditer(p, t)]
        for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", t):
            s = m[0]
            need = secrets.LIMITS["words" if not re.search("[0-9]", s) else "hex" if re.fullmatch("[0-9a-fA-F]+", s) else "alnum" if s.isalnum() else "base64"]
            if not any(re.search(p, s) for p in secrets.ALLOW) and max(entropy(s[k : k + 20]) for k in range(len(s) - 19)) >= need:
                spans.append(m.span())
        out, at = [], 0
        for a, b in sorted(spans):
            if b > at:
                out += [t[at:a], "[SECRET]"] if a >= at else []
                at = b
        ids = [*tok.encode("".join([*out, t[at:]]), add_special_tokens=False).ids, 0]
        want[i] = (len(ids), zlib.crc32(np.array(ids[:1024], "<u4").tobytes()) if len(ids) >= 1024 else None)
    got = cp.run(spark, sf).toPandas()
    assert {r.doc_id: r.doc_tokens for r in got.itertuples()} == {i: n for i, (n, _) in want.items()}
    assert got.groupby("doc_id").length.sum().to_dict() == {i: n for i, (n, _) in want.items()}
    first = got[(got.start == 0) & (got.length == 1024)]
    assert all(want[r.doc_id][1] == r.ids_crc32 for r in first.itertuples())
    assert (got.groupby("sequence_id").length.sum() <= 1024).all()
