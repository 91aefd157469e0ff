"""Decontamination, cross-tokenizer alignment and run detection against brute force, and their edge cases."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from webstrata.llm import alignment, contamination, queries, runs

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words int, part string, shard string, runs int"
A, B = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None, 1, "x", "y", 2) for i, t in rows], DOCS)


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- decontamination ---


def _hits(docs, items, window=10):
    """Every window of every item looked up at every place."""
    held = {}
    for item, text in items:
        words = contamination.split_words(text or "")
        for at in range(max(1, len(words) - window + 1) if words else 0):
            held.setdefault(tuple(words[at : at + window]), set()).add(item)
    out = []
    for doc, text in docs:
        words, hit, found = contamination.split_words(text or ""), set(), set()
        for size in {len(k) for k in held}:
            for at in range(len(words) - size + 1):
                if (key := tuple(words[at : at + size])) in held:
                    hit.update(range(at, at + size))
                    found |= held[key]
        out.append((doc, len(words), len(hit), sorted(x for x in found if x is not None)))
    return sorted(out, key=repr)


def _texts(rng, n):
    words = ["the", "of", "Été", "x1", "a", "日本"]
    docs = [(i, rng.choice([" ", ". ", "\n"]).join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 30, 300])))) for i in range(n)]
    items = [(str(i), " ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 9, 10, 11, 25])))) for i in range(6)]
    items += [("copy", docs[3][1][5:400]), ("copy", docs[4][1][:90]), (None, "the the of"), ("none", None), ("marks", " .,- ")]
    return [*docs, docs[3], docs[3], (None, docs[4][1]), (None, None), (7, None), (8, "")], items


@pytest.mark.parametrize("seed,shard_words", [(1, 1 << 20), (2, 40), (3, 12)])
def test_index_finds_what_brute_force_finds(spark, seed, shard_words):
    docs, items = _texts(random.Random(seed), 12)
    found = contamination.find_contamination(_docs(spark, docs), spark.createDataFrame(items, "item_id string, text string"), shard_words=shard_words)
    got = [(r.doc_id, r.n_words, sum(h.end - h.start for h in r.hits), r["items"]) for r in found.collect()]
    assert sorted(got, key=repr) == _hits(docs, items)


def test_items_in_several_blocks_give_the_same(spark):
    docs, items = _texts(random.Random(4), 12)
    table, index = spark.createDataFrame(items, "item_id string, text string"), contamination.index_shards(_docs(spark, docs), keep_texts=True)
    one = contamination.search_index(index, table).select("doc_id", "n_words", "hits", "items", "text").collect()
    many = contamination.search_index(index, table, block_bytes=300).select("doc_id", "n_words", "hits", "items", "text").collect()
    assert sorted(map(repr, one)) == sorted(map(repr, many))


def test_a_written_index_is_searched_again(spark, tmp_path):
    docs, items = _texts(random.Random(5), 8)
    contamination.index_shards(_docs(spark, docs)).write.parquet(str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    for part in (items, items[:3]):
        rows = contamination.search_index(index, spark.createDataFrame(part, "item_id string, text string")).collect()
        assert sorted([(r.doc_id, r.n_words, sum(h.end - h.start for h in r.hits), r["items"]) for r in rows], key=repr) == _hits(docs, part)


def test_spans_are_cut_out_of_the_text(spark):
    phrase = "one two three four five six seven eight nine ten"
    docs = _docs(spark, [(1, f"Before, {phrase.title()}! After. {phrase} end"), (2, "clean text"), (3, phrase), (4, None)])
    rows = {r.doc_id: r for r in contamination.decontaminate(docs, spark.createDataFrame([("i", phrase)], "item_id string, text string")).collect()}
    assert [rows[k].text for k in (1, 2, 3, 4)] == ["Before, ! After.  end", "clean text", "", None]


def test_no_items_or_no_documents(spark):
    none = spark.createDataFrame([], "item_id string, text string")
    row = contamination.summarize(contamination.find_contamination(_docs(spark, [(1, "a b")]), none)).collect()
    assert [tuple(r) for r in row] == [(1, 2, 0, 0, _sha(""), False)]
    assert contamination.find_contamination(_docs(spark, []), none).collect() == []


def test_suffix_order_is_the_order_of_suffixes():
    rng = random.Random(6)
    for _ in range(200):
        pieces = [[rng.randint(1, 3) for _ in range(rng.randint(0, 30))] for _ in range(rng.randint(1, 5))]
        text = [x for p in pieces for x in (*p, 0)]
        ends = [text.index(0, i) for i in range(len(text))]
        want = sorted(range(len(text)), key=lambda i: (text[i : ends[i]] + [0], ends[i]))
        assert contamination.suffix_order(np.array(text), 2).tolist() == want


# --- alignment ---


def _aligned(text, byte, piece, bytes_a, bytes_b):
    if not text:
        return 0, 0, 0, "", []
    whole, a, b = (" " + text).encode(), byte.encode(" " + text, add_special_tokens=False).ids, piece.encode(text)
    parts_a, parts_b = [bytes_a(i) for i in a], [bytes_b(i) for i in b]
    if b"".join(parts_a) != whole or b"".join(parts_b) != whole:
        return 0, 0, 0, "", []
    ends_a, ends_b = np.cumsum([len(x) for x in parts_a]), np.cumsum([len(x) for x in parts_b])
    groups, links, i, j = [], [], 0, 0
    for end in sorted(set(ends_a.tolist()) & set(ends_b.tolist())):
        ni, nj = int(np.searchsorted(ends_a, end)) + 1, int(np.searchsorted(ends_b, end)) + 1
        groups.append(",".join(map(str, a[i:ni])) + "|" + ",".join(map(str, b[j:nj])))
        links.append((a[ni - 1], b[nj - 1]))
        i, j = ni, nj
    return len(a), len(b), len(groups), ";".join(groups), links


def _libraries():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    byte, piece = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    byte.no_truncation()
    byte.no_padding()
    byte.encode_special_tokens = True
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in printable)}

    def bytes_a(i):
        return bytes(byte_of[c] for c in byte.id_to_token(i))

    def bytes_b(i):
        p = piece.id_to_piece(i)
        return bytes.fromhex(p[3:5]) if p.startswith("<0x") and len(p) == 6 else p.replace("▁", " ").encode()

    return byte, piece, bytes_a, bytes_b


def test_alignment_equals_the_libraries(spark, sf):
    rng = random.Random(7)
    odd = [None, "", " ", "a", "<s> <|endoftext|> </s><unk>", "  two  spaces ", "日本語 テキスト 🎉🎉", "\n\n\t x", "ﬁ ½ Ⅳ", "a\0b", "▁x", "<0x41>", "word " * 5000, "x" * 5000]
    texts = odd + ["".join(rng.choice("ab é日🎉 \n\t.<>|s/") for _ in range(rng.randint(1, 60))) for _ in range(150)]
    texts += [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    docs = [(None if k % 50 == 7 else k, t) for k, t in enumerate(texts)] + [(3, "a"), (3, "a")]
    found = [_aligned(t, *_libraries_once()) for _, t in docs]
    count, best = {}, {}
    for x in found:
        for link in x[4]:
            count[link] = count.get(link, 0) + 1
    for (a, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    want = []
    for (doc, _), (n_a, n_b, n_groups, groups, links) in zip(docs, found, strict=True):
        want.append((doc, n_a, n_b, n_groups, len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), _sha(groups) if n_groups else ""))
    got = [tuple(r) for r in alignment.summarize(_docs(spark, docs), A, B).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


_held: list = []


def _libraries_once():
    if not _held:
        _held.extend(_libraries())
    return _held


def test_rare_pairs_are_joined_by_key(spark, sf):
    from webstrata.llm.common import materialize

    aligned = materialize(alignment.align_documents(spark.read.parquet(f"{sf}/documents.parquet").limit(80), A, B), "aligned")
    columns = ["part", "num", "n_links", "n_best", "count_sum"]
    all_hot, few_hot, none_hot = (sorted(map(tuple, alignment.score_links(aligned, n).select(*columns).collect())) for n in (1 << 19, 50, 0))
    assert all_hot == few_hot == none_hot and len(all_hot) == 80


def test_pieces_of_any_size_give_the_same_overlaps():
    rng = random.Random(8)
    for _ in range(400):
        n = rng.randint(1, 50)
        a, b = (np.array(sorted({*rng.sample(range(1, n + 1), rng.randint(1, n)), n})) for _ in range(2))
        for piece in (1, 2, 3, 7, 1000):
            ends, of_a, of_b, closes = alignment.overlaps(a, b, piece)
            assert ends.tolist() == sorted({*a.tolist(), *b.tolist()})
            assert of_a.tolist() == np.searchsorted(a, ends).tolist() and of_b.tolist() == np.searchsorted(b, ends).tolist()
            assert closes.tolist() == [e in a and e in b for e in ends]
            i, j = alignment.diagonal_cuts(a, b, piece)
            assert (np.diff(i + j)[:-1] == piece).all() and i[-1] == len(a) and j[-1] == len(b)


def test_alignment_of_an_empty_table(spark):
    assert alignment.summarize(_docs(spark, []), A, B).collect() == []


# --- runs ---


def _runs(words, exponent=4, least=6):
    out, n = [], len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            start = i
            while i < n - q and words[i] == words[i + q]:
                i += 1
            size = i - start + q
            primitive = all(any(words[k] != words[k + d] for k in range(start, start + size - d)) for d in range(1, q))
            if i > start and size >= max(least, exponent * q) and primitive:
                out.append((start, size, q))
            i += i == start
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_lyndon_lengths_are_the_longest_lyndon_words():
    rng = random.Random(9)
    for _ in range(1500):
        text = [rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(rng.randint(0, 30))]
        want = [next((j for j in range(i + 1, len(text)) if text[j:] < text[i:]), len(text)) - i for i in range(len(text))]
        assert runs.lyndon_lengths(text) == want


def test_runs_equal_brute_force():
    rng = random.Random(10)
    for _ in range(2000):
        text = [rng.randrange(rng.choice([1, 2, 2, 3, 6])) for _ in range(rng.randint(0, 40))]
        if text and rng.random() < 0.5:
            p, a = rng.randint(1, 6), rng.randrange(len(text))
            text = [x if i < a else text[a + (i - a) % p] for i, x in enumerate(text)]
        for exponent, least in ((4, 6), (2, 2), (3, 1)):
            assert runs.find_runs(text, exponent, least) == _runs(text, exponent, least), text


def test_long_texts_take_linear_time():
    assert runs.find_runs([0] * 300_000) == [(0, 300_000, 1)]
    assert runs.find_runs([0, 1, 2, 0, 1, 2, 3] * 40_000) == [(0, 280_000, 7)]
    a, b = [0], [0, 1]
    while len(b) < 200_000:
        a, b = b, b + a
    assert runs.find_runs(b) == []


def _digest(doc, text):
    words = [w.decode() for w in (text or "").encode().split()]
    h, n = zlib.crc32(str(doc).encode()), len(words)
    if doc is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = _runs(words)
    drop = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2])) if found else (None, None, None)
    kept = " ".join(w for i, w in enumerate(words) if i not in drop)
    return (doc, len(found), *best, 1000 * best[1] // best[2] if found else None, _sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), _sha(kept))


def test_run_digests_equal_brute_force(spark, sf):
    rng = random.Random(11)
    docs = [(i, rng.choice([" ", "\n", " \t "]).join(rng.choice(["a", "b", "é", "c\xa0d"]) for _ in range(rng.randint(0, 90)))) for i in range(150)]
    docs += [(None, "x x x x x x x"), (None, None), (160, None), (161, ""), (162, " \n "), (3, "y y y y y y"), (3, "y y y y y y"), (170, "w" * 5000 + " q" * 400)]
    docs += [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if len(r.text) < 1500]
    got = [tuple(r) for r in runs.summarize(runs.detect_runs(runs.with_periods(_docs(spark, docs)))).collect()]
    assert sorted(got, key=repr) == sorted((_digest(*d) for d in docs), key=repr)
    assert any(r[1] for r in got) and runs.detect_runs(_docs(spark, [])).collect() == []


def test_collapsed_text_keeps_one_period(spark):
    row = runs.detect_runs(_docs(spark, [(1, "see the cat the cat the cat the cat now now now now now now end")])).first()
    assert row.collapsed == "see the cat now end" and [tuple(r) for r in row.runs] == [(1, 8, 2), (9, 6, 1)]


def test_registered_queries_cover_their_tables(spark, sf):
    found = queries.queries()
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    for name in ("op11_fm_index", "op12_merge_path", "op13_baier_runs"):
        assert found[name](spark, sf).count() == n
