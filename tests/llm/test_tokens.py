import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from newtonmill.llm import chunks, token_files
from newtonmill.llm.bpe import Bpe, bpe_encode
from newtonmill.llm import token_counts as T
from newtonmill.llm.token_counts import token_counts

from . import cases

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
SIGNS = ["the", "THE ", "ing", "haha", "aaaaaaa", "....", ", ", ". ", "!,", "'s", "é", "É ", "Σ", "İ", "ß", "中", "😀", "١", "7", "12", " ", "\n", "\t", "\x1c", "\x85", "\xa0", "　", "<|endoftext|>", "<|startoftext|>", "<|", "_", "”", "́", "\0", "  "]


def texts(n=1500):
    rng = random.Random(2)
    return ["".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 25))) for _ in range(n)] + ["", "x" * 5000, "ab" * 3000 + " " + "the " * 2000]


@pytest.fixture(scope="module")
def word():
    return Tokenizer.from_file(WORD)


def test_dynamic_programme_equals_the_library(word):
    bpe, data = Bpe(WORD), texts()
    ids, borders, decoded = bpe.encode(data)
    for k, t in enumerate(data):
        want = word.encode(t, add_special_tokens=False).ids
        assert ids[borders[k] : borders[k + 1]].tolist() == want, t
        assert decoded[k] == word.decode(want, skip_special_tokens=False)


def test_every_token_is_its_own_encoding():
    bpe = Bpe(WORD)
    strings = [t[: -len("</w>")] for t in bpe.vocab if t.endswith("</w>") and len(t) > 4]
    plain = [t for t in strings if t.isascii() and t.isalpha()]
    found = bpe.encode_words(plain)
    assert all(found[t] == (bpe.vocab[t + "</w>"],) for t in plain) and len(plain) > 10_000


@pytest.mark.parametrize("block", [1 << 10, 8 << 20])
def test_token_counts_equal_the_library(spark, monkeypatch, block):
    monkeypatch.setattr(T, "BLOCK_BYTES", block)
    monkeypatch.setattr(T, "TOLD_ROWS", block)
    library, data = Tokenizer.from_file(BYTE), [*texts(), "word " * 300_000, "漢" * 3000, " ", "\n", " lead", "trail ", "\n\nx\n y"]
    df = spark.createDataFrame(list(enumerate(data)), "doc_id long, text string").repartition(3).selectExpr("*", "1 as block", "2 as codes")
    found = {r.doc_id: r for r in token_counts(df, BYTE).collect()}
    assert len(found) == len(data)
    for k, t in enumerate(data):
        n = len(library.encode(t, add_special_tokens=False).ids)
        assert (found[k].n_bytes, found[k].n_tokens, found[k].over_limit) == (len(t.encode()), n, n > 1024), t[:100]


def test_counts_go_back_to_their_blocks(spark):
    """Every block's pre-tokens get their counts, whatever the number of blocks."""
    df = spark.createDataFrame([(k, "the same words in every row and a new one" + str(k)) for k in range(400)], "doc_id long, text string").repartition(4)
    lists = [r.pretokens for r in T.frequencies(df, BYTE, "doc_id", "text").collect()]
    assert len(lists) == 4 and all(len(x) == len(set(x)) for x in lists)
    words = [(b, k, w) for b, x in enumerate(lists) for k, w in enumerate(x)]
    told = T.piece_counts(spark.createDataFrame(words, "block long, place int, pretoken string"), BYTE).collect()
    library, found = Tokenizer.from_file(BYTE), {}
    for r in told:
        found |= {(r.block, p): n for p, n in zip(np.cumsum(T._unpacked(r.places)).tolist(), T._unpacked(r.pieces).tolist())}
    assert found == {(b, k): len(library.encode(w).ids) for b, k, w in words} and len(words) > len({w for _, _, w in words})


@pytest.mark.parametrize(("field", "value"), [("normalizer", {"type": "NFKC"}), ("pre_tokenizer", {"type": "Whitespace"}), ("added_tokens", [{"id": 1, "content": "x", "single_word": True, "lstrip": False, "rstrip": False, "normalized": False}])])
def test_other_vocabularies_are_refused(tmp_path, field, value):
    import json

    for path, kind, make in ((WORD, "word", Bpe), (WORD, "word", token_files.LibraryEncoder), (BYTE, "byte", T.PreTokens)):
        spec = json.load(open(path, encoding="utf-8")) | {field: value}
        (tmp_path / "v.json").write_text(json.dumps(spec), encoding="utf-8")
        with pytest.raises(ValueError, match=f"no {kind} vocabulary"):
            make(str(tmp_path / "v.json"))
    with pytest.raises(ValueError):
        T.PreTokens(WORD)


def test_a_byte_that_the_vocabulary_lacks_is_told(tmp_path):
    import json

    spec = json.load(open(WORD, encoding="utf-8"))
    q = {t: i for t, i in spec["model"]["vocab"].items() if "q" in t}
    spec["model"]["vocab"] = {t: i for t, i in spec["model"]["vocab"].items() if t not in q}
    spec["model"]["merges"] = [m for m in spec["model"]["merges"] if not any("q" in x for x in (m if isinstance(m, list) else m.split(" ")))]
    (tmp_path / "v.json").write_text(json.dumps(spec), encoding="utf-8")
    with pytest.raises(ValueError, match="symbol"):
        Bpe(str(tmp_path / "v.json")).encode_words(["aqa"])


def test_library_encoder_equals_the_library(word):
    encoder, data = token_files.LibraryEncoder(WORD), texts()
    ids, borders = encoder.encode(data, None)
    for k, t in enumerate(data):
        assert ids[borders[k] : borders[k + 1]].tolist() == word.encode(t, add_special_tokens=False).ids, t


def test_a_full_table_forgets_and_stays_right():
    table = chunks.ChunkTable(lambda fresh: [tuple(map(ord, c)) for c in fresh], 50)
    rng = random.Random(5)
    for _ in range(60):
        data = ["".join(rng.choice("abcde") for _ in range(rng.randint(0, 4))) for _ in range(40)]
        codes = table.codes(data, len(data))
        assert table.gather(codes).tolist() == [ord(c) for t in data for c in t]
        assert len(table.numbers) <= 90


def test_variable_length_code_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 4, 5, 1000):
        values = (rng.integers(0, 1 << 32, n) >> rng.integers(0, 32, n)).astype(np.uint32)
        control, data = token_files.pack(values)
        assert len(control) == -(-n // 4)
        assert np.array_equal(token_files.unpack(control, data, n), values)
    assert len(token_files.pack(np.arange(256))[1]) == 256


def test_file_set_round_trip(spark, word, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_IDS", 300)
    monkeypatch.setattr(token_files, "SHARD_IDS", 2000)
    data = cases.rows()
    folder = str(tmp_path / "set")
    token_files.write_token_files(cases.frame(spark, data), folder, WORD, end=2)
    found = sorted(token_files.read_token_files(spark, folder).collect(), key=lambda r: r.start)
    assert len(found) == len(data)
    assert [r.doc_id is not None for r in found] == [False] + [True] * (len(data) - 1)
    assert [r.doc_id for r in found[1:]] == sorted(i for i, _ in data if i is not None)
    texts, at = {}, 0
    for i, t in data:
        texts.setdefault(i, t)
    for r in found:
        want = np.array([*word.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r.start, r.n_tokens, zlib.crc32(bytes(r.ids))) == (at, len(want), zlib.crc32(want.tobytes()))
        at += len(want)


def test_operators_keep_every_row(spark, word):
    data = cases.rows()
    library = Tokenizer.from_file(BYTE)
    coded = bpe_encode(cases.frame(spark, data), WORD).collect()
    want = sorted((i or -1, word.encode(t or "", add_special_tokens=False).ids) for i, t in data)
    assert sorted((r.doc_id or -1, r.ids) for r in coded) == want
    counted = token_counts(cases.frame(spark, data), BYTE, limit=20).collect()
    sizes = [(i or -1, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in data]
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in counted) == sorted((*s, s[2] > 20) for s in sizes)


def test_empty_tables(spark, tmp_path):
    empty = cases.frame(spark, [])
    assert bpe_encode(empty, WORD).count() == 0 and token_counts(empty, BYTE).count() == 0
    token_files.write_token_files(empty, str(tmp_path / "none"), WORD, end=2)
    assert token_files.read_token_files(spark, str(tmp_path / "none")).count() == 0
