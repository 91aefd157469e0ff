"""BPE by automaton: merges compiled into a deterministic token automaton, run by tables.

The automaton reads tokens and accepts exactly the correct tokenisations (Berglund, Martens and
van der Merwe, 2024).  Each merge (a, b) in turn adds its gadget: the arcs labelled a get an end state
of their own (a copy, if others share it) which b can't leave any more, and the new arc ab starts
wherever the arc a does at that moment and ends where b does.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex
from tokenizers.normalizers import NFC, Lowercase
from tokenizers.pre_tokenizers import Split

from webstrata.llm.common import slices

#: Fixed value: Unicode White_Space by code point.
SPACES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
END = "</w>"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _class_of(pattern: str) -> str:
    """The code points of a class, as ranges: what the tokenizers library takes for it, by its own Unicode tables.

    Planes without letters, numbers or spaces in any version (unassigned and private ones) are left out.
    """
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x40000), *range(0xE0000, 0xE1000)]))
    found = Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(every)
    return "".join(f"\\U{ord(run[0]):08X}-\\U{ord(run[-1]):08X}" for run, _ in found)


@cache
def letter_run() -> regex.Pattern:
    return regex.compile(f"[{_class_of(r'\p{L}+')}]+")


@cache
def piece_pattern() -> regex.Pattern:
    """The pre-tokenizer's pattern; letters, numbers and white space are those of the library."""
    letters = letter_run().pattern
    number, space = _class_of(r"\p{N}+"), _class_of(r"\s+")
    return regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|{letters}|[{number}]|[^{space}{letters[1:-2]}{number}]+")


@cache
def newer_points() -> regex.Pattern:
    """Code points that this Python doesn't know, but the library may: it is asked for their composition and case."""
    unknown = [c for c in range(0x40000) if unicodedata.category(chr(c)) == "Cn"]
    first = [c for c, before in zip(unknown, [-1, *unknown], strict=False) if c != before + 1]
    last = [c for c, after in zip(unknown, [*unknown[1:], -1], strict=True) if after != c + 1]
    return regex.compile("[" + "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in zip(first, last, strict=True)) + "]")


@cache
def letters_known() -> bool:
    """Whether Python and the library agree on which of the code points that Python knows are letters."""
    letters = letter_run()
    return all((letters.match(c) is not None) == c.isalpha() for c in map(chr, range(0x40000)) if not 0xD800 <= ord(c) < 0xE000 and unicodedata.category(c) != "Cn")


class TokenAutomaton:
    """Tables of the automaton for one tokenizer file whose last symbols carry an end mark."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.labels = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for label, i in [*vocab.items(), *self.special.items()]:
            self.labels[i] = label
        self._compile([(vocab[a], vocab[b], vocab[a + b]) for a, b in merges])
        self._spell(vocab)

    def _compile(self, merges: list[tuple[int, int, int]]) -> None:
        """States by successive gadgets; legal: a bit for each state and token.

        A state keeps which labels were taken from it, and when.  Label ab copies the arcs of a, so
        taking a at time k also takes the labels that begin with a and were made from time k on, with
        all that begin with those.  Numbered in depth-first order by first part, they are a range.
        """
        end_of = [0] * len(self.labels)  # the state in which a token's arcs end
        taken: list[list[tuple[int, int]]] = [[]]
        sharers = [len(self.labels) - len(merges)]
        children: list[list[tuple[int, int]]] = [[] for _ in self.labels]
        made = [True] * len(self.labels)
        for k, (a, b, ab) in enumerate(merges):
            s, last = end_of[a], end_of[b]
            if sharers[s] > 1 or a == b:  # aa may be followed by a: it keeps the state as it was
                sharers[s] -= 1
                end_of[a] = len(taken)
                taken.append([*taken[s], (b, k)])
                sharers.append(1)
            else:
                taken[s].append((b, k))
            end_of[ab] = last
            sharers[last] += 1
            children[a].append((k, ab))
            made[ab] = False
        place, until = [0] * len(self.labels), [0] * len(self.labels)
        count, stack = 0, [(t, False) for t in range(len(self.labels)) if made[t]]
        while stack:
            t, done = stack.pop()
            if done:
                until[t] = count
                continue
            place[t] = count
            count += 1
            stack.append((t, True))
            stack += [(c, False) for _, c in reversed(children[t])]
        legal = np.zeros((len(taken), (count + 7) // 8), np.uint8)
        for s, gone in enumerate(taken):
            row = np.ones(count, bool)
            for b, k in gone:
                row[place[b]] = False
                at = bisect.bisect_left(children[b], (k, -1))
                if at < len(children[b]):
                    row[place[children[b][at][1]] : until[b]] = False
            legal[s] = np.packbits(row, bitorder="little")
        self.legal, self.place, self.state = legal, np.array(place, np.int32), np.array(end_of, np.int32)

    def _spell(self, vocab: dict[str, int]) -> None:
        """A trie over the bytes of all tokens, as sorted arcs; mid and last: a node's token."""
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        spare = [b for b in range(256) if b not in printable]
        byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(spare)}
        arcs: dict[int, int] = {}
        mid, last = {}, {}
        for label, i in vocab.items():
            if label in self.special:
                continue
            whole, ends = (label[: -len(END)], last) if label.endswith(END) else (label, mid)
            node = 0
            for c in whole:
                node = arcs.setdefault(node << 8 | byte_of[c], len(arcs) + 1)
            ends[node] = i
        self.longest = max(map(len, vocab))
        self.arc_keys = np.array(sorted(arcs), np.int64)
        self.arc_ends = np.array([arcs[k] for k in self.arc_keys.tolist()], np.int32)
        self.mid, self.last = np.full(len(arcs) + 1, -1, np.int32), np.full(len(arcs) + 1, -1, np.int32)
        for table, ends in ((self.mid, mid), (self.last, last)):
            table[list(ends)] = list(ends.values())

    def encode_words(self, words: list[str], cells: int = 1 << 20, alone: int = 4096) -> list[list[int]]:
        """Token ids of each word (not empty).

        Words of like length run through the tables together, in blocks of at most ``cells`` places
        (words times the longest one's bytes); a word of more than ``alone`` bytes runs by itself.
        """
        raw = [w.encode("utf-8", "replace") for w in words]
        order = sorted(range(len(raw)), key=lambda k: len(raw[k]))
        out: list[list[int]] = [[]] * len(raw)
        at = 0
        while at < len(order):
            if len(raw[order[at]]) > alone:
                out[order[at]] = self._run_long(raw[order[at]])
                at += 1
                continue
            end = at + 1
            while end < len(order) and (end + 1 - at) * (len(raw[order[end]]) + 1) <= cells and len(raw[order[end]]) <= alone:
                end += 1
            for k, ids in zip(order[at:end], self._run([raw[k] for k in order[at:end]]), strict=True):
                out[k] = ids
            at = end
        return out

    def _matches(self, word: bytes, begin: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """End, start and token of every label that starts in word[begin:end], by end."""
        flat = np.frombuffer(word, np.uint8)
        start = np.arange(begin, end)
        node = np.zeros(len(start), np.int64)
        found: tuple[list, list, list] = ([], [], [])
        for depth in range(len(word) - begin):
            live = start + depth < len(word)
            start, node = start[live], node[live]
            key = node << 8 | flat[start + depth]
            arc = np.minimum(np.searchsorted(self.arc_keys, key), len(self.arc_keys) - 1)
            hit = self.arc_keys[arc] == key
            start, node = start[hit], self.arc_ends[arc[hit]].astype(np.int64)
            if not len(start):
                break
            token = np.where(start + depth + 1 == len(word), self.last[node], self.mid[node])
            some = token >= 0
            for col, v in zip(found, (start[some] + depth + 1, start[some], token[some]), strict=True):
                col.append(v)
        ends, starts, tokens = map(np.concatenate, found) if found[0] else (np.zeros(0, np.int64),) * 3
        order = np.argsort(ends, kind="stable")
        return ends[order], starts[order], tokens[order]

    def _run_long(self, word: bytes, block: int = 1 << 16) -> list[int]:
        """One long word: labels are matched for a block of starts at a time, then taken by their ends.

        An end whose labels may start in a later block too waits for it.  Token and start are kept for
        each byte, and the states of the last ones.
        """
        n, wide = len(word), self.legal.shape[1]
        if not hasattr(self, "_legal_bytes"):
            self._legal_bytes = self.legal.tobytes()
        legal, places, states = self._legal_bytes, self.place, self.state
        state, token, back = np.zeros(n + 1, np.int32), np.zeros(n + 1, np.int32), np.zeros(n + 1, np.int32)
        rest = (np.zeros(0, np.int64),) * 3
        for begin in range(0, n, block):
            end = min(n, begin + block)
            ends, starts, tokens = (np.concatenate(x) for x in zip(rest, self._matches(word, begin, end), strict=True))
            order = np.argsort(ends, kind="stable")
            ends, starts, tokens = ends[order], starts[order], tokens[order]
            ready = int(np.searchsorted(ends, end, side="right"))
            rest = (ends[ready:], starts[ready:], tokens[ready:])
            at, to = places[tokens[:ready]], states[tokens[:ready]]
            low = max(0, begin - self.longest)  # states of earlier bytes are no longer asked for
            window = state[low : end + 1].tolist()
            for e, s, t, p, q in zip(ends[:ready].tolist(), starts[:ready].tolist(), tokens[:ready].tolist(), at.tolist(), to.tolist(), strict=True):
                if legal[window[s - low] * wide + (p >> 3)] >> (p & 7) & 1:
                    window[e - low] = q
                    token[e], back[e] = t, s
            state[low : end + 1] = window
        ids, i = [], n
        while i:
            ids.append(int(token[i]))
            i = int(back[i])
        return ids[::-1]

    def _run(self, words: list[bytes]) -> list[list[int]]:
        n, size = len(words), np.array([len(w) for w in words])
        longest = int(size.max())
        flat = np.frombuffer(b"".join(words), np.uint8)
        begin = np.cumsum(size) - size
        state = np.zeros((longest + 1, n), np.int32)
        token = np.zeros((longest + 1, n), np.int32)
        back = np.zeros((longest + 1, n), np.int32)
        row = start = node = np.zeros(0, np.int64)
        for i in range(1, longest + 1):
            fresh = np.flatnonzero(size >= i)
            live = size[row] >= i
            row = np.concatenate([row[live], fresh])
            start = np.concatenate([start[live], np.full(len(fresh), i - 1)])
            node = np.concatenate([node[live], np.zeros(len(fresh), np.int64)])
            key = node << 8 | flat[begin[row] + i - 1]
            arc = np.minimum(np.searchsorted(self.arc_keys, key), len(self.arc_keys) - 1)
            hit = self.arc_keys[arc] == key
            row, start, node = row[hit], start[hit], self.arc_ends[arc[hit]].astype(np.int64)
            found = np.where(size[row] == i, self.last[node], self.mid[node])
            some = np.flatnonzero(found >= 0)
            t, r, s = found[some], row[some], start[some]
            before = state[s, r]
            at = self.place[t]
            legal = (self.legal[before, at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            t, r, s = t[legal], r[legal], s[legal]
            state[i, r], token[i, r], back[i, r] = self.state[t], t, s
        tokens, backs = token.T.tolist(), back.T.tolist()
        out = []
        for k, i in enumerate(size.tolist()):
            ids = []
            while i:
                ids.append(tokens[k][i])
                i = backs[k][i]
            out.append(ids[::-1])
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """The labels of the arcs, joined as the library does where a file names no decoder."""
        return " ".join([self.labels[i] for i in ids])


class Recent(dict):
    """What was found lately, about ``room`` characters of keys at most in each of two generations."""

    def __init__(self, room: int):
        self.room, self.used, self.old = room, 0, {}

    def missing(self, keys: Iterable[str]) -> list[str]:
        """Keys to look up elsewhere; those of the older generation are taken over."""
        out = []
        for k in keys:
            if k not in self:
                if k in self.old:
                    self[k] = self.old[k]
                    self.used += len(k)
                else:
                    out.append(k)
        return out

    def turn(self) -> None:
        if self.used > self.room:
            self.old, self.used = dict(self), 0
            self.clear()

    def add(self, new: dict) -> None:
        self.update(new)
        self.used += sum(map(len, new))


class TextEncoder:
    """Whole texts to ids and labels.  Runs between white space and their pieces are kept a while."""

    def __init__(self, path: str, room: int = 3_000_000):
        self.automaton = TokenAutomaton(path)
        self.id_texts = [str(i) for i in range(len(self.automaton.labels))]
        self.runs = re.compile("[^" + "".join(map(chr, SPACES)) + "]+")
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.automaton.special)) + ")") if self.automaton.special else None
        self.known, self.words = Recent(room), Recent(room)

    @staticmethod
    def pieces(run: str) -> list[str]:
        """Canonical composition, lower case by character, split by the pattern."""
        if run.isascii():
            run, letters = run.lower(), str.isalpha
        else:
            letters = letter_run().fullmatch
            if newer_points().search(run):
                run = Lowercase().normalize_str(NFC().normalize_str(run))
            else:
                letters = str.isalpha if letters_known() else letters
                run = unicodedata.normalize("NFC", run)
                run = "".join([c.lower() for c in run]) if "Σ" in run else run.lower()
        if letters(run):
            return [run]
        return [run[:-1], run[-1]] if run[-1] in ".," and letters(run[:-1]) else piece_pattern().findall(run)

    def _learn(self, runs: list[str]) -> dict[str, tuple[int, str, str]]:
        split = {run: self.pieces(run) for run in runs}
        self.words.turn()
        new = self.words.missing({p for ps in split.values() for p in ps})
        labels, texts = self.automaton.labels, self.id_texts
        self.words.add({w: (len(got), " ".join([texts[i] for i in got]), " ".join([labels[i] for i in got])) for w, got in zip(new, self.automaton.encode_words(new), strict=True)})
        found = {}
        for run, ps in split.items():
            if len(ps) == 1:
                found[run] = self.words[ps[0]]
            else:
                got = [self.words[p] for p in ps]
                found[run] = (sum([g[0] for g in got]), " ".join([g[1] for g in got]), " ".join([g[2] for g in got]))
        return found

    def encode(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """For each text: number of ids, decimal ids joined by a space, decoded text."""
        special = self.automaton.special
        split = []
        for text in texts:
            if self.special and "<" in text and self.special.search(text):
                split.append([r for p in self.special.split(text) for r in ([p] if p in special else self.runs.findall(p))])
            else:
                split.append(self.runs.findall(text))
        self.known.turn()
        need = self.known.missing(set().union(*split))
        whole = {s: (1, str(special[s]), s) for s in need if s in special}
        self.known.add(self._learn([r for r in need if r not in whole]) | whole)
        out = []
        for runs in split:
            counts, ids, labels = zip(*map(self.known.__getitem__, runs), strict=True) if runs else ((), (), ())
            if 0 in counts:  # a run that normalises to nothing
                ids, labels = [i for i in ids if i], [x for x in labels if x]
            out.append((sum(counts), " ".join(ids), " ".join(labels)))
        return out


_encoders: dict[str, TextEncoder] = {}


def encode_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Encode whole texts and decode them again, one row per document in, one out.

    Returns doc_id, n_tokens, ids_sha256, decoded_sha256; with ``keep_ids`` also ids (array<int>)
    and decoded (string).  Null text is empty: no ids, the digests of the empty string.  Repeated
    rows and null ids pass through; an empty table gives no rows; other columns are ignored.  Very
    long texts and words take memory in proportion to their length.

    A map over partitions: no shuffle.  Tables of the automaton are built once per worker from the
    tokenizer's file, which every executor must see at ``tokenizer_path``.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get(tokenizer_path) or _encoders.setdefault(tokenizer_path, TextEncoder(tokenizer_path))
        for batch in slices(batches):
            got = encoder.encode([t or "" for t in batch.column(1).to_pylist()])
            cols = [batch.column(0), pa.array([g[0] for g in got], pa.int64())]
            cols += [pa.array([hashlib.sha256(g[k].encode()).hexdigest() for g in got], pa.string()) for k in (1, 2)]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                cols += [pa.array([[int(i) for i in g[1].split()] for g in got], pa.list_(pa.int32())), pa.array([g[2] for g in got], pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(encode, DIGESTS + (", ids array<int>, decoded string" if keep_ids else ""))
