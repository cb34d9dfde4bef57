"""Byte-level BPE against the tiktoken library."""

import base64
import random

import pytest
import tiktoken
from pyspark.sql import functions as F

from vulnlake.llm import bytepairs
from vulnlake.llm.common import tokenizer_file, word_pattern

ALPHABETS = ["etaoin", "abcdefghijklmnopqrstuvwxyzéüßж", "中国的人大我们在有是不", "ab"]


@pytest.fixture(scope="module")
def library():
    ranks = bytepairs.read_ranks(tokenizer_file("byte_bpe_multi_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=word_pattern(), mergeable_ranks=ranks, special_tokens={})


def texts():
    r = random.Random(3)
    odd = ["", None, " ", "a", "éa", "\n" * 1000, " " * 600 + "a", "    don't  I'LL \n\n\t x ", "a\u0085b\x1cc\ufeff\u00a0d",
           "12345 ½ ²³ ٣٤", "!!" * 300, "😀" * 200, "<|endoftext|>", "x" * 257, "a" * 2100, "哈哈" * 400, "ab" * 900, "中文没有空格的文本" * 100]
    long = ["".join(r.choice(a) for _ in range(n)) for a in ALPHABETS for n in (255, 256, 257, 700, 1500)]
    plain = [" ".join("".join(r.choice(r.choice(ALPHABETS)) for _ in range(r.randrange(1, 12))) for _ in range(60)) for _ in range(60)]
    return odd + long + plain + plain[:5]


@pytest.mark.parametrize("frequent", [0, 50, bytepairs.FREQUENT_WORDS])
def test_ids_and_bytes(spark, make_docs, library, frequent):
    """Whether a word is held by the tasks or encoded in place, long words included."""
    all_texts = texts()
    docs = make_docs(list(enumerate(all_texts)))
    rows = bytepairs.encode_documents(spark, docs, tokenizer_file("byte_bpe_multi_50k.tiktoken"), word_pattern(), frequent=frequent).collect()
    assert len(rows) == len(all_texts)
    for row in rows:
        text = all_texts[row.doc_id] or ""
        ids = library.encode_ordinary(text)
        assert row.ids == ",".join(map(str, ids)) and row.n_tokens == len(ids), text[:50]
        assert bytes(row.decoded) == text.encode()


def test_arrays_of_ids(spark, library):
    ids = library.encode_ordinary("Décode moi, 中文 😀")
    table = spark.createDataFrame([(",".join(map(str, ids)),), ("",)], "ids string").select(bytepairs.as_array(F.col("ids")).alias("a"))
    vocabulary = bytepairs.Vocabulary(tokenizer_file("byte_bpe_multi_50k.tiktoken"))
    out = table.select("a", bytepairs.decode(F.col("a"), vocabulary).alias("b")).collect()
    assert [r.a for r in out] == [ids, []] and bytes(out[0].b).decode() == "Décode moi, 中文 😀" and bytes(out[1].b) == b""


def test_empty_table(spark, make_docs):
    out = bytepairs.encode_documents(spark, make_docs([]), tokenizer_file("byte_bpe_multi_50k.tiktoken"), word_pattern())
    assert out.columns == ["doc_id", "n_tokens", "ids", "decoded"] and out.count() == 0


def test_token_that_no_merge_reaches(spark, make_docs, tmp_path):
    """A word that is a token of its own takes its rank, as in the library."""
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 256, b"de": 257}
    path = tmp_path / "own.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % r for t, r in ranks.items()))
    own = tiktoken.Encoding("own", pat_str=word_pattern(), mergeable_ranks=ranks, special_tokens={})
    rows = bytepairs.encode_documents(spark, make_docs([(0, "abc"), (1, "abcde de")]), str(path), word_pattern()).collect()
    assert {r.doc_id: r.ids for r in rows} == {i: ",".join(map(str, own.encode_ordinary(t))) for i, t in [(0, "abc"), (1, "abcde de")]}


def test_words_of_any_length(library):
    """Both ways of merging, at lengths about the one where they change."""
    r = random.Random(8)
    for n in [1, 2, 3, *range(bytepairs.LONG - 3, bytepairs.LONG + 4), 1000]:
        for alphabet in ALPHABETS:
            word = "".join(r.choice(alphabet) for _ in range(n))
            ids = library._encode_single_piece(word.encode())
            assert bytepairs.merge(library._mergeable_ranks, word.encode()) == ids, word
            assert bytepairs._merge_long(library._mergeable_ranks, word.encode()) == ids or len(ids) == 1


def test_words_forgotten(library):
    """More words than a worker remembers, within one text and over several."""
    r = random.Random(9)
    encode = bytepairs.Encoder(bytepairs._file(tokenizer_file("byte_bpe_multi_50k.tiktoken")), word_pattern(), 20)
    for _ in range(20):
        text = " ".join("".join(r.choice("etaoin") for _ in range(r.randrange(1, 4))) for _ in range(200))
        ids = library.encode_ordinary(text)
        assert encode.text(text) == (len(ids), ",".join(map(str, ids)), text.encode())
        assert len(encode.known) <= 10 and len(encode.older) <= 10


def test_plan_holds_no_vocabulary(spark, make_docs, capsys):
    """The rank file goes to the tasks, not into the driver's plan."""
    bytepairs.encode_documents(spark, make_docs([(0, "a")]), tokenizer_file("byte_bpe_multi_50k.tiktoken"), word_pattern()).explain(True)
    assert len(capsys.readouterr().out) < 20_000
