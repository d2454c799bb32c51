"""Texts as numbered chunks: what is worked out once per distinct chunk serves every text by table lookup."""

import json
import unicodedata
from collections.abc import Callable, Iterable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


#: Rules of the two kinds of vocabulary files that operators here take apart. Fixed values of the tokenizer files.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True}
RULES = {
    "word": (
        {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
        {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": WORDS}, "behavior": "Removed", "invert": True}, _BYTES | {"use_regex": False}]},
        "</w>",
    ),
    "byte": (None, _BYTES | {"use_regex": True}, None),
}


def vocabulary_spec(path: str, kind: str) -> dict:
    """The contents of a tokenizers file, whose normalizer, pre-tokens, word ends and special strings must be those that this package works by."""
    spec = json.load(open(path, encoding="utf-8"))
    model = spec["model"]
    own = (spec["normalizer"], spec["pre_tokenizer"], model.get("end_of_word_suffix"))
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
    if own != RULES[kind] or not plain or any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError(f"{path} is no {kind} vocabulary with the rules expected here")
    return spec


class _Numbers(dict):
    """Numbers keys as they come and lists the new ones."""

    def __init__(self) -> None:
        self.fresh: list[str] = []

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        self.fresh.append(key)
        return n


class ChunkTable:
    """Integer sequences of distinct chunks, made once each by `make` for a list of new chunks.

    It lives in a worker across batches. With more than `bound` chunks it forgets those met once, and the rarer half of
    the rest if need be, so its memory does not grow with the data; a chunk met again is then made again.
    """

    def __init__(self, make: Callable[[list[str]], list], bound: int) -> None:
        self.make, self.bound = make, bound
        self.numbers, self.flat, self.start, self.length = _Numbers(), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.seen = np.zeros(0, np.int64)

    def _forget(self) -> None:
        least = max(2, int(np.partition(self.seen, -self.bound // 2)[-self.bound // 2]))
        kept = np.flatnonzero(self.seen >= least)[: self.bound // 2]
        names = list(self.numbers)
        self.flat, self.length, self.seen = self.gather(kept), self.length[kept], self.seen[kept] // 2
        self.start = np.cumsum(self.length) - self.length
        self.numbers = _Numbers()
        self.numbers.update((names[k], n) for n, k in enumerate(kept.tolist()))

    def codes(self, chunks: Iterable[str], n: int) -> np.ndarray:
        if len(self.numbers) > self.bound:
            self._forget()
        out = np.fromiter(map(self.numbers.__getitem__, chunks), np.int32, n)
        if self.numbers.fresh:
            made = self.make(self.numbers.fresh)
            self.numbers.fresh.clear()
            length = np.fromiter(map(len, made), np.int64, len(made))
            flat = np.fromiter(chain.from_iterable(made), np.int32, int(length.sum()))
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(length) - length])
            self.length, self.flat = np.concatenate([self.length, length]), np.concatenate([self.flat, flat])
        self.seen = np.bincount(out, minlength=len(self.length)) + np.concatenate([self.seen, np.zeros(len(self.length) - len(self.seen), np.int64)])
        return out

    def spaced(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the chunks between ASCII white space of all texts, and the border of each text.

        Arrow splits and numbers the chunks of these texts, so that only their distinct ones are looked up here."""
        lists = pc.ascii_split_whitespace(pa.array(texts, pa.string()))
        own = lists.flatten().dictionary_encode()
        names = own.dictionary.to_pylist()
        codes = self.codes(names, len(names))
        return codes[own.indices.to_numpy()], lists.offsets.to_numpy() - lists.offsets[0].as_py()

    def gather(self, codes: np.ndarray) -> np.ndarray:
        """The sequences of all codes, one after another."""
        length = self.length[codes]
        ends = np.cumsum(length)
        return self.flat[np.repeat(self.start[codes] - ends + length, length) + np.arange(ends[-1] if len(ends) else 0)]


def _kind(c: str) -> int:
    return 32 if c.isspace() else 44 if c in ",." else 97 if unicodedata.category(c)[0] in "LN" else 33


#: Classes of Latin-1 characters: space, comma or period, letter or digit, and the rest.
_KINDS = bytes(_kind(chr(c)) for c in range(256))


def spaced_words(text: str) -> str:
    """The text with ASCII white space alone, and commas and periods apart from words where no other sign touches them.

    For vocabularies whose pattern takes runs of letters, single digits and runs of signs: the pre-tokens stay the same,
    while far fewer chunks are distinct."""
    try:
        kinds = text.encode("latin-1").translate(_KINDS)
    except UnicodeEncodeError:
        return " ".join(text.split())
    if b",," in kinds or b",!" in kinds or b"!," in kinds:
        return " ".join(text.split())
    text = text.replace(",", " , ").replace(".", " . ")
    return text if text.isascii() else text.replace("\xa0", " ").replace("\x85", " ")


def per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values between the borders first[i] and first[i + 1]."""
    sums = np.concatenate([[0], np.cumsum(values)])
    return sums[first[1:]] - sums[first[:-1]]


def groups(texts: list[str], most: int = 2 << 20) -> Iterable[tuple[int, int]]:
    """Ranges of texts of about `most` characters, so that the lists of chunks stay small."""
    i, size = 0, 0
    for j, text in enumerate(texts):
        if size and size + len(text) > most:
            yield i, j
            i, size = j, 0
        size += len(text)
    if i < len(texts):
        yield i, len(texts)
