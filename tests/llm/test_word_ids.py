"""Ids of the word tokenizer equal the library's on every text."""

import random
import unicodedata

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from sievemark.llm import sstable

PATH = public_tokenizers.path("word_bpe_49k.json")
LETTERS = [chr(c) for c in range(0x80, 0x30000) if unicodedata.category(chr(c))[0] in "LMN"]
ODD = [*map(chr, range(0x958, 0x960)), "İ", "ড়", "יִ", "בֿ", "K", "ẞ", "Σ", "́", "̇", "̸", "‍", "　", " ", "\u0085", " "]
ASCII = [*map(chr, range(0x20, 0x7F)), "\n", "\t", "\r", "\x0b", " ", " ", " "]


@pytest.fixture(scope="module")
def both():
    with open(PATH, encoding="utf-8") as f:
        return sstable.WordEncoder(f.read()), Tokenizer.from_file(PATH)


def differ(both, texts):
    mine, library = both
    got = [ids.tolist() for at in range(0, len(texts), 4000) for ids in mine.encode(pa.array(texts[at : at + 4000], pa.string()))]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    return [(t, g, w) for t, g, w in zip(texts, got, want, strict=True) if g != w]


def test_random_texts(both):
    rng = random.Random(21)
    texts = ["".join(rng.choice((LETTERS, ODD, ASCII, ASCII)[rng.randrange(4)]) for _ in range(rng.randrange(14))) for _ in range(20_000)]
    assert differ(both, texts) == []


def test_every_letter_before_a_sign(both):
    assert differ(both, [c + s for c in LETTERS + ODD for s in (")", ".", "-a")]) == []


def test_hindi_words_before_signs(both):
    assert differ(both, ["लड़का, पढ़. कख़) क़-क़", "ख़)", "ज़.", "ढ़-", "İ) İ)"]) == []


def test_through_the_query(spark, tmp_path):
    texts = ["ख़) and İ) end", None, "", "ज़. ড়, x", "plain words, here."]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    from sievemark.llm import queries

    library = Tokenizer.from_file(PATH)
    want = {i: len(library.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["n_tokens"] for r in queries.QUERIES["op10_sstable"](spark, str(tmp_path)).collect()} == want
