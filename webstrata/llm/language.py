"""Language identification by cross-parsing entropy.

Each language's labelled sample becomes a suffix automaton.  A text is parsed from left to right
into the longest phrases that occur in the sample; the language that needs the fewest phrases,
normalised by the text's length and the log of the sample's, wins (Ziv and Merhav, 1993).
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webstrata.llm.common import slices

GUESSES = "doc_id long, lang_pred string, score double, n_letters long, phrase_rate double"
UNKNOWN = "und"
#: Characters of a lane, the unit that is parsed in step with others, and classes with a column in the tables.
LANE, DENSE = 512, 64
#: Rounds in which all lanes are mended side by side.
ROUNDS = 2


class Alphabet:
    """Letter classes of lower-cased text: 0 is any run of other characters, 1 a letter of no sample, then the others, most frequent first."""

    def __init__(self, samples: dict[str, str]):
        chars, counts = np.unique(np.array([ord(c) for s in samples.values() for c in s.lower() if c.isalpha()], np.int64), return_counts=True)
        self.letters = np.array([chr(c).isalpha() for c in range(0x110000)], bool)
        self.classes = self.letters.astype(np.int32)
        self.classes[chars[np.lexsort((chars, -counts))]] = np.arange(2, len(chars) + 2)
        self.size = len(chars) + 2

    def codes(self, text: str) -> np.ndarray:
        code = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
        got = self.classes[code]
        keep = got > 0
        keep[1:] |= got[:-1] > 0  # of a run of other characters the first stays
        return got[keep]


class SuffixAutomaton:
    """Parsing tables of a text: what follows on state and class is 2 * next state, plus 1 if a phrase ends.

    A phrase that can't go on ends, and the class read begins the next one.  The DENSE most frequent
    classes have a table of all states; arcs of rarer ones are kept as sorted keys.
    """

    def __init__(self, codes: list[int], size: int):
        go: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in codes:
            cur = len(go)
            go.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in go[p]:
                go[p][c] = cur
                p = link[p]
            if p >= 0:
                q = go[p][c]
                if length[q] == length[p] + 1:
                    link[cur] = q
                else:
                    twin = len(go)
                    go.append(dict(go[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and go[p].get(c) == q:
                        go[p][c] = twin
                        p = link[p]
                    link[q] = link[cur] = twin
            last = cur
        self.size, self.wide = size, min(size, DENSE)
        start = np.full(size, len(go), np.int64)  # the last state: a class that the text lacks is a phrase alone
        start[list(go[0])] = list(go[0].values())
        self.fresh = 2 * start + 1
        table = np.tile(self.fresh[: self.wide], (len(go) + 1, 1)).astype(np.int32)
        table[0] -= 1  # the first state is left at once and for good: nothing ends there
        rare = []
        for state, arcs in enumerate(go):
            usual = [c for c in arcs if c < self.wide]
            table[state, usual] = [2 * arcs[c] for c in usual]
            rare += [(state * size + c, 2 * t) for c, t in arcs.items() if c >= self.wide]
        self.table = np.ascontiguousarray(table).ravel()
        rare.sort()
        self.rare = dict(rare)
        self.rare_keys, self.rare_next = np.array([k for k, _ in rare] or [-1], np.int64), np.array([t for _, t in rare] or [0], np.int64)

    def follow(self, state: np.ndarray, c: np.ndarray, rare: bool) -> np.ndarray:
        """Next entries of states and classes; rare: some class may lie outside of the table."""
        if not rare:
            return self.table[state * self.wide + c]
        got = self.table[state * self.wide + np.minimum(c, self.wide - 1)]
        at = np.flatnonzero(c >= self.wide)
        if len(at):
            key = state[at] * self.size + c[at]
            place = np.minimum(np.searchsorted(self.rare_keys, key), len(self.rare_keys) - 1)
            got[at] = np.where(self.rare_keys[place] == key, self.rare_next[place], self.fresh[c[at]] - (state[at] == 0))
        return got


    def walk(self, state: int, classes: list[int], starts: list[bool]) -> tuple[int, int, bool]:
        """Phrases more than ``starts`` has, the last state, and whether a phrase begins where one began: one lane, step by step."""
        table, wide, more = memoryview(self.table), self.wide, 0
        for c, old in zip(classes, starts, strict=True):
            if c < wide:
                got = table[state * wide + c]
            else:
                got = self.rare.get(state * self.size + c)
                got = int(self.fresh[c]) - (state == 0) if got is None else got
            state, new = got >> 1, got & 1
            more += new - old
            if new and old:
                return more, state, True
        return more, state, False


class CrossParser:
    """Suffix automata of all languages over one alphabet."""

    def __init__(self, samples: dict[str, str]):
        self.languages = sorted(samples)
        self.alphabet = Alphabet(samples)
        self.automata, self.logs = [], []
        for lang in self.languages:
            codes = self.alphabet.codes(samples[lang])
            self.automata.append(SuffixAutomaton(codes.tolist(), self.alphabet.size))
            self.logs.append(np.log2(len(codes) + 2))

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases by text and language, letters by text, parsed characters by text.

        Texts are parsed in lanes of LANE characters, all lanes of the batch in step, each as if a
        phrase began with it.  Then each lane's first characters are parsed again from where the lane
        before it ended, until a phrase begins where one began before: from there on both parsings are
        the same.  So the counts are those of one parse over the whole text.
        """
        coded = [self.alphabet.codes(t) for t in texts]
        sizes = np.array([len(c) for c in coded], np.int64)
        letters = np.array([int((c > 0).sum()) for c in coded], np.int64)
        counts = np.zeros((len(texts), len(self.languages)), np.int64)
        if not sizes.sum():
            return counts, letters, sizes
        flat = np.concatenate(coded).astype(np.int64)
        rare = bool(self.automata) and int(flat.max()) >= self.automata[0].wide
        base = np.cumsum(sizes) - sizes
        lanes = -(-sizes // LANE)
        text_of = np.repeat(np.arange(len(texts)), lanes)
        nth = np.arange(len(text_of)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        begin, span = base[text_of] + nth * LANE, np.minimum(LANE, sizes[text_of] - nth * LANE)
        order = np.argsort(-span, kind="stable")
        ordered = begin[order]
        live = np.searchsorted(-span[order], -np.arange(LANE), side="left")  # lanes longer than each step
        states = [np.zeros(len(begin), np.int64) for _ in self.automata]
        starts = [np.zeros(len(flat), bool) for _ in self.automata]  # where phrases begin
        for step in range(int(span.max())):
            m = int(live[step])
            at = ordered[:m] + step
            c = flat[at]
            for k, automaton in enumerate(self.automata):
                got = automaton.follow(states[k][:m], c, rare)
                starts[k][at] = got & 1
                states[k][:m] = got >> 1
        for k, automaton in enumerate(self.automata):
            starts[k][begin] = True
            ends = np.empty(len(begin), np.int64)
            ends[order] = states[k]
            more = self._mend(automaton, flat, rare, starts[k], ends, begin, span, np.flatnonzero(nth))
            found = np.add.reduceat(starts[k].astype(np.int64), begin) + more
            counts[:, k] = np.bincount(text_of, weights=found, minlength=len(texts)).astype(np.int64)
        return counts, letters, sizes

    @staticmethod
    def _mend(automaton: SuffixAutomaton, flat: np.ndarray, rare: bool, starts: np.ndarray, ends: np.ndarray, begin: np.ndarray, span: np.ndarray, lanes: np.ndarray) -> np.ndarray:
        """How many phrases more each lane has when it goes on from the lane before it; lanes: those that do.

        Nearly all lanes settle in two rounds.  Where parsings don't meet (a run of one letter, say), each change
        would go on to the next lane round by round; what is left is parsed lane after lane instead, each lane once.
        """
        own_ends, more, later = ends.copy(), np.zeros(len(begin), np.int64), lanes
        for _ in range(ROUNDS):
            if not len(lanes):
                return more
            state, before = ends[lanes - 1], ends[lanes]
            more[lanes], ends[lanes] = 0, own_ends[lanes]
            at, step = np.arange(len(lanes)), 0
            while len(at):
                lane = lanes[at]
                place = begin[lane] + step
                got = automaton.follow(state[at], flat[place], rare)
                new, old = got & 1 == 1, starts[place]
                more[lane] += new.astype(np.int64) - old
                state[at] = got >> 1
                step += 1
                last = ~(new & old) & (span[lane] == step)  # the parsings don't meet in this lane
                ends[lane[last]] = state[at[last]]
                at = at[~(new & old) & (span[lane] > step)]
            lanes = np.intersect1d(lanes[ends[lanes] != before] + 1, later)
        if not len(lanes):
            return more
        goes_on, open_ = np.zeros(len(begin) + 1, bool), np.zeros(len(begin) + 1, bool)
        goes_on[later], open_[lanes] = True, True
        for lane in range(int(lanes[0]), len(begin)):
            if open_[lane]:
                before, part = ends[lane], slice(begin[lane], begin[lane] + span[lane])
                more[lane], end, met = automaton.walk(int(ends[lane - 1]), flat[part].tolist(), starts[part].tolist())
                ends[lane] = own_ends[lane] if met else end
                open_[lane + 1] |= ends[lane] != before and goes_on[lane + 1]
        return more

    def guess(self, texts: list[str]) -> list[tuple[str, float, int, float]]:
        """Language, score, letters and phrases a character (of the winner) for each text."""
        counts, letters, sizes = self.phrases(texts)
        cost = counts * np.array(self.logs)[None, :] if self.logs else counts
        out = []
        for k in range(len(texts)):
            if not letters[k] or not self.languages:
                out.append((UNKNOWN, 0.0, int(letters[k]), 0.0))
                continue
            order = np.argsort(cost[k], kind="stable")
            best = cost[k][order[0]]
            score = 1.0 - best / cost[k][order[1]] if len(order) > 1 else 1.0
            out.append((self.languages[order[0]], float(score), int(letters[k]), float(counts[k][order[0]] / sizes[k])))
        return out


def held_out(id_col: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def learn_samples(docs: DataFrame, rows: int = 48, chars: int = 24_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, str]:
    """A sample of labelled text per language, for ``CrossParser``.

    Of each language the ``rows`` ids with the smallest hash, none held out, among those with a text
    that has a letter; each gives one text's first ``2 * chars / rows`` characters (from the first
    letter on if these hold none), ``chars`` in all.  These bounds hold at any input size.
    """
    each = 2 * chars // rows
    text = F.col(text_col)
    first = F.substring(text, 1, each)
    first = F.when(first.rlike(r"\p{L}"), first).otherwise(F.substring(F.regexp_replace(text, r"^\P{L}+", ""), 1, each))
    good = docs.filter(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & text.rlike(r"\p{L}")).select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).alias("lang"), first.alias("first"))
    ids = good.filter(~held_out(F.col("id"))).select("lang", "id").distinct()
    most = ids.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))  # of a large language only ids with small hashes are ranked, some 20 times as many as are taken
    small = F.pmod(F.xxhash64("id"), F.lit(1 << 31)) / F.lit(float(1 << 31)) <= F.lit(20.0 * rows) / F.col("n")
    ids = ids.join(most, "lang").filter(small).select("lang", "id")
    order = Window.partitionBy("lang").orderBy(F.pmod(F.xxhash64("id"), F.lit(1 << 31)), "id")
    chosen = {(r["lang"], r["id"]) for r in ids.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= rows).collect()}
    one = good.filter(F.col("id").isin([i for _, i in chosen])).groupBy("lang", "id").agg(F.min("first").alias("first")) if chosen else None
    got = [(r["lang"], r["hash"], r["first"]) for r in one.withColumn("hash", F.xxhash64("id")).collect() if (r["lang"], r["id"]) in chosen] if chosen else []
    samples: dict[str, str] = {}
    for lang, _, text in sorted(got, key=lambda r: (r[0], r[1], r[2] or "")):
        if text and len(samples.get(lang, "")) < chars:
            samples[lang] = (samples.get(lang, "") + "\n" + text)[:chars]
    return {lang: s for lang, s in samples.items() if any(c.isalpha() for c in s)}


_parsers: dict[int, CrossParser] = {}


def identify_languages(docs: DataFrame, samples: dict[str, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The language of every whole text: doc_id, lang_pred, score (0 to 1), n_letters, phrase_rate.

    score: how many fewer normalised phrases the winner needs than the next language, as a share.
    phrase_rate: the winner's phrases a character; near 1 where nothing longer than a letter fits.

    'und', score 0: the text is null or has no letter, or nothing was learned.  Ties go to the first
    language by name.  Repeated rows and null ids pass through; an empty table gives no rows.
    A map over partitions; workers build the automata once from the bounded samples.  Texts of any
    length are parsed whole, with all letters of all samples told apart.
    """
    parser = _shared_parser(docs, samples)

    def identify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            got = parser().guess([t or "" for t in batch.column(1).to_pylist()])
            langs, scores, letters, rates = zip(*got, strict=True)
            cols = [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(letters, pa.int64()), pa.array(rates, pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["doc_id", "lang_pred", "score", "n_letters", "phrase_rate"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(identify, GUESSES)


def _shared_parser(docs: DataFrame, samples: dict[str, str]) -> Callable[[], CrossParser]:
    """The parser, built once in each worker from the bounded samples."""
    shared = docs.sparkSession.sparkContext.broadcast(samples)
    token = zlib.crc32(repr(sorted(samples.items())).encode())

    def parser() -> CrossParser:
        if token not in _parsers:
            _parsers.clear()
            _parsers[token] = CrossParser(shared.value)
        return _parsers[token]

    return parser


def keep_known(docs: DataFrame, samples: dict[str, str], max_phrase_rate: float, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose text has letters and fits a learned language."""
    parser = _shared_parser(docs, samples)
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            got = parser().guess([t or "" for t in batch.column(at).to_pylist()])
            yield batch.filter(pa.array([lang != UNKNOWN and rate <= max_phrase_rate for lang, _, _, rate in got], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
