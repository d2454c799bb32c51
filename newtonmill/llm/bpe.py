"""BPE encoding by dynamic programming over prefixes, and decoding.

For every prefix of a pre-token the encoding ends in one token, found without encoding the prefix anew: it is the
suffix token that may follow the last token of what precedes it. Suffix tokens come from a suffix automaton of the
vocabulary; whether two tokens may stand side by side is decided once per pair and kept. Following the last tokens
backwards from the end of the pre-token emits its ids. Pre-tokens are taken in order, so one that begins as the one
before it goes on from their common prefix.

Both tables are bounded, the automaton by the vocabulary and the kept pairs and pre-tokens by a parameter.
"""

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import WORDS, ChunkTable, groups, spaced_words, vocabulary_spec
from .store import small

#: Distinct chunks and pre-tokens that a worker keeps.
KEPT = 300_000
WORD_END = 256


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class SuffixAutomaton:
    """Of all strings given, over integer symbols: each state stands for substrings with the same continuations."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]

    def _state(self, length: int, moves: dict[int, int], link: int) -> int:
        self.next.append(moves)
        self.len.append(length)
        self.link.append(link)
        return len(self.len) - 1

    def _split(self, p: int, c: int) -> int:
        """The state of the string of length len[p] + 1 that p reaches by c."""
        q = self.next[p][c]
        if self.len[q] == self.len[p] + 1:
            return q
        twin = self._state(self.len[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = twin
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = twin
            p = self.link[p]
        return twin

    def add(self, symbols: tuple[int, ...]) -> None:
        last = 0
        for c in symbols:
            if c in self.next[last]:
                last = self._split(last, c)
                continue
            p, new = last, self._state(self.len[last] + 1, {}, 0)
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = self.link[p]
            self.link[new] = self._split(p, c) if p >= 0 else 0
            last = new

    def state(self, symbols: tuple[int, ...]) -> int:
        s = 0
        for c in symbols:
            s = self.next[s][c]
        return s


class Bpe:
    """Encoder and decoder of one vocabulary file with word ends; path names a tokenizers .json file."""

    def __init__(self, path: str) -> None:
        import regex

        spec = vocabulary_spec(path, "word")
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        end, letters = spec["model"]["end_of_word_suffix"], {c: b for b, c in byte_letters().items()}
        self.rank: dict[tuple[int, int], int] = {}
        halves: dict[int, tuple[int, int]] = {}
        for r, (a, b) in enumerate(spec["model"]["merges"]):
            pair = self.vocab[a], self.vocab[b]
            self.rank[pair] = r
            halves[self.vocab[a + b]] = pair
        self.made = {t: self.rank[pair] for t, pair in halves.items()}
        self.halves = halves
        self.automaton = SuffixAutomaton()
        strings = {}
        for t, i in self.vocab.items():
            body, ends = (t[: -len(end)], True) if t.endswith(end) and len(t) > len(end) else (t, False)
            s = tuple(letters[c] for c in body)
            strings[i] = (*s[:-1], s[-1] + WORD_END) if ends else s
            self.automaton.add(strings[i])
        self.at: dict[int, list[tuple[int, int]]] = {}
        for i, s in strings.items():
            self.at.setdefault(self.automaton.state(s), []).append((len(s), i))
        self.chains: dict[int, tuple[tuple[int, int], ...]] = {0: (), -1: ()}
        self.beside: dict[int, bool] = {}
        self.words = regex.compile(WORDS)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.odd = regex.compile("[\x1c-\x1f]")  # white space to str.split() alone
        self.by_space = regex.compile(r"\P{White_Space}+").findall
        self.kept: dict[str, tuple[int, ...]] = {}
        self.table = ChunkTable(self._chunks, KEPT)

    def _chain(self, state: int) -> tuple[tuple[int, int], ...]:
        """(length, id) of all tokens that are suffixes of the state's strings, longest first."""
        found = self.chains.get(state)
        if found is None:
            found = self.chains[state] = (*sorted(self.at.get(state, ()), reverse=True), *self._chain(self.automaton.link[state]))
        return found

    def _spine(self, t: int, side: int) -> list[tuple[int, float]]:
        """The pieces of t at one of its ends, and the rank of the merge that takes each in."""
        out, taken = [], float("inf")
        while True:
            out.append((t, taken))
            if t not in self.halves:
                return out
            taken, t = self.made[t], self.halves[t][side]

    def may_follow(self, a: int, b: int) -> bool:
        """Whether merging the symbols of a and b gives just a and b: no pair across their border is merged before either side takes it in."""
        key = a << 20 | b
        found = self.beside.get(key)
        if found is None:
            if len(self.beside) > KEPT:
                self.beside.clear()
            left = self._spine(a, 1)
            found = self.beside[key] = not any(r < x_taken and r <= y_taken for y, y_taken in self._spine(b, 0) for x, x_taken in left if (r := self.rank.get((x, y))) is not None)
        return found

    def _last(self, state: int, length: int, i: int, last: list[int]) -> int:
        for n, t in self._chain(state):
            if n <= length and (n == i or self.may_follow(last[i - n], t)):
                return t
        raise ValueError("a symbol is not in the vocabulary")

    def encode_words(self, words: list[str]) -> dict[str, tuple[int, ...]]:
        """Ids of pre-tokens (normalized, not empty)."""
        moves, link, lens, out = self.automaton.next, self.automaton.link, self.automaton.len, {}
        before, states, matched, last = b"", [0], [0], [0]

        def step(c: int, i: int) -> tuple[int, int, int]:
            s, n = states[i], matched[i]
            while c not in moves[s]:
                if not s:
                    raise ValueError("a symbol is not in the vocabulary")
                s = link[s]
                n = lens[s]
            s, n = moves[s][c], n + 1
            return s, n, self._last(s, n, i + 1, last)

        sizes = {}
        for word, text in sorted((w, w.encode()) for w in words):
            i, most = 0, min(len(text) - 1, len(states) - 1)
            while i < most and text[i] == before[i]:
                i += 1
            del states[i + 1 :], matched[i + 1 :], last[i + 1 :]
            for i in range(i, len(text) - 1):
                s, n, t = step(text[i], i)
                states.append(s)
                matched.append(n)
                last.append(t)
            before, i = text, len(text)
            t = step(text[-1] + WORD_END, i - 1)[2]
            ids = []
            while True:
                ids.append(t)
                n = sizes.get(t)
                if n is None:
                    n = sizes[t] = self._size(t)
                i -= n
                if not i:
                    break
                t = last[i]
            out[word] = tuple(reversed(ids))
        return out

    def _size(self, t: int) -> int:
        return self._size(self.halves[t][0]) + self._size(self.halves[t][1]) if t in self.halves else 1

    def normalize(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        # a capital sigma is lower-cased without regard to its place
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def _chunks(self, chunks: list[str]) -> list:
        """Ids of new chunks; the pre-tokens of those that are not one word are kept, as they stand in many chunks."""
        split = {c: self.words.findall(c) for c in chunks if not c.isalpha() and c not in self.special}
        if len(self.kept) > KEPT:
            self.kept.clear()
        self.kept |= self.encode_words(list({w for ws in split.values() for w in ws if w not in self.kept}))
        single = self.encode_words([c for c in chunks if c.isalpha()])
        return [single[c] if c in single else [self.special[c]] if c in self.special else [i for w in split[c] for i in self.kept[w]] for c in chunks]

    def spaced(self, text: str) -> str:
        """The normalized text, its chunks and special tokens between white space; the vocabulary's pattern matches nothing across it."""
        plain = (lambda p: " ".join(self.by_space(self.normalize(p)))) if self.odd.search(text) else (lambda p: spaced_words(self.normalize(p)))
        if "<|" in text:
            return " ".join(p if p in self.special else plain(p) for p in self.specials.split(text))
        return plain(text)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """All ids one after another, the border of each text, and the decoded texts."""
        codes, first = self.table.spaced([self.spaced(t) for t in texts])
        ids = self.table.gather(codes)
        borders = np.concatenate([[0], np.cumsum(self.table.length[codes])])[first]
        return ids, borders, self.decode(ids, borders)

    def decode(self, ids: np.ndarray, borders: np.ndarray) -> list[str]:
        """As the library's decode with special tokens kept: this vocabulary has no decoder, so tokens are joined by spaces."""
        names = list(map(self.tokens.__getitem__, ids.tolist()))
        return [" ".join(names[a:b]) for a, b in zip(borders[:-1].tolist(), borders[1:].tolist())]


_open: dict[str, Bpe] = {}


def opened(path: str) -> Bpe:
    """The encoder of a vocabulary file, built once in each Python process."""
    if path not in _open:
        _open[path] = Bpe(path)
    return _open[path]


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, ids, decoded) of each row: the ids of the whole text without added special tokens, and what they decode to.

    Null and empty texts give no ids and an empty decoded text. Rows are handled one by one, so repeated or null
    ids do no harm, and other columns of docs are not looked at. path: a vocabulary file that every executor has.
    """

    def kernel(batches):
        bpe = opened(path)
        for batch in small(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for i, j in groups(texts):
                ids, borders, decoded = bpe.encode(texts[i:j])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(np.diff(borders), pa.int64()), pa.ListArray.from_arrays(pa.array(borders, pa.int32()), pa.array(ids, pa.int32())), pa.array(decoded, pa.string())],
                    ["id", "n_tokens", "ids", "decoded"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(kernel, f"id {kind}, n_tokens long, ids array<int>, decoded string")
    return out.withColumnRenamed("id", id_col)
