"""Alignment of two tokenizers against a plain walk over all links."""

import json
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import sentencepiece
from tokenizers import Tokenizer

from vulnlake.llm import alignment
from vulnlake.llm.common import tokenizer_file

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
SIGNS = ["a", "b", "é", "中", "😀", " ", "  ", "\n", "\t", "the ", "'s ", "Ünï", "\u0085", "\u00a0", "\u3000", "\x1c", ".", "...", "1", "<s>", "<0x41>", "ing"]


def texts():
    r = random.Random(5)
    odd = ["", None, " ", "  ", "a", " a", "a ", "a  b", "x ▁ y", "<|endoftext|> <unk> <s>", "\n\n", "a\n b", "a \nb", "中文没有空格" * 50, "a" * 5_000]
    mixed = ["".join(r.choice(SIGNS) for _ in range(r.randrange(1, 60))) for _ in range(150)]
    plain = [" ".join("".join(r.choice("etaoinshr") for _ in range(r.randrange(1, 9))) for _ in range(50)) for _ in range(60)]
    return odd + mixed + plain + plain[:7]


def expected(docs):
    a = Tokenizer.from_file(tokenizer_file(A))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file(B))
    signs = alignment.byte_alphabet()
    names = {i: n for n, i in json.load(open(tokenizer_file(A)))["model"]["vocab"].items()}
    out, counts = [], Counter()
    for text in docs:
        whole = (" " + (text or "")).encode()
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        of_a = [bytes(signs[c] for c in names[i]) for i in ids_a]
        of_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in ids_b)]
        if b"".join(of_a) != whole or b"".join(of_b) != whole:
            out.append(None)
            continue
        ends_a, ends_b = np.cumsum(list(map(len, of_a))), np.cumsum(list(map(len, of_b)))
        links = [(x, y) for x, ex, lx in zip(ids_a, ends_a, map(len, of_a)) for y, ey, ly in zip(ids_b, ends_b, map(len, of_b))
                 if max(ex - lx, ey - ly) < min(ex, ey)] if len(whole) < 3_000 else [
            (ids_a[np.searchsorted(ends_a, e)], ids_b[np.searchsorted(ends_b, e)]) for e in sorted({*ends_a.tolist(), *ends_b.tolist()})]
        common = sorted({*ends_a.tolist()} & {*ends_b.tolist()})
        groups, low = [], 0
        for e in common:
            groups.append(",".join(str(i) for i, x in zip(ids_a, ends_a) if low < x <= e) + "|" + ",".join(str(i) for i, x in zip(ids_b, ends_b) if low < x <= e))
            low = e
        counts.update(links)
        out.append((len(ids_a), len(ids_b), len(common), links, ";".join(groups)))
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    return [(0, 0, 0, 0, 0, 0, "") if x is None else
            (x[0], x[1], x[2], len(x[3]), sum(counts[k] == best[k[1]] for k in x[3]), sum(counts[k] for k in x[3]), x[4]) for x in out]


@pytest.mark.parametrize("broadcast_bytes,units,bucket", [(alignment.BROADCAST_BYTES, 100_000, 1 << 15), (alignment.BROADCAST_BYTES, 50, 64), (0, 50, 64)])
def test_against_all_links(spark, make_docs, monkeypatch, broadcast_bytes, units, bucket):
    """With the table of pairs in hand or joined; units forgotten in between; many buckets and summing levels."""
    monkeypatch.setattr(alignment, "UNITS", units)
    monkeypatch.setattr(alignment, "BUCKET", bucket)
    monkeypatch.setattr(alignment, "FAN_IN", 2)
    docs = texts()
    table = make_docs(list(enumerate(docs))).repartition(5)
    got = alignment.align_documents(spark, table, tokenizer_file(A), tokenizer_file(B), broadcast_bytes=broadcast_bytes)
    rows = {r.doc_id: tuple(r)[1:] for r in got.collect()}
    want = expected(docs)
    assert len(rows) == len(docs)
    for i, row in enumerate(want):
        assert rows[i] == row, docs[i]


@pytest.mark.parametrize("n", [0, 1, 2, 1_000, 50_000])
def test_perfect_hash(n):
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 44, n))
    table = alignment.PerfectHash.from_bytes(alignment.PerfectHash.of(keys).to_bytes())
    assert sorted(table.index(keys).tolist()) == list(range(len(keys)))
    counts = alignment.PairCounts([(0, table.to_bytes(), (dense := np.sort(keys)[np.argsort(table.index(np.sort(keys)))]).tobytes(), (dense + 1).tobytes())], 1)
    assert (counts.look_up(keys) == keys + 1).all() and (counts.look_up(keys + (1 << 50)) == 0).all()


def test_empty_table(spark, make_docs):
    assert alignment.align_documents(spark, make_docs([]), tokenizer_file(A), tokenizer_file(B)).count() == 0


def test_units_are_kept_between_tasks(monkeypatch):
    """A second task of the same pass aligns no unit again and counts the same."""
    class Files:
        value = tuple(open(tokenizer_file(n), "rb").read() for n in (A, B))

    class Context:
        @staticmethod
        def get():
            return type("Task", (), {"partitionId": lambda self: 0})()

    aligned, plain = [], alignment.Pair.align
    monkeypatch.setattr(alignment, "TaskContext", Context)
    monkeypatch.setattr(alignment.Pair, "align", lambda self, units, groups=False: aligned.append(len(units)) or plain(self, units, groups))
    step = alignment._counted(Files)
    first, second = (pd.concat(step(iter([pd.DataFrame({"text": texts()})]))).sort_values("key") for _ in range(2))
    assert len(aligned) == 1 and first["key"].tolist() == second["key"].tolist() and first["n"].tolist() == second["n"].tolist()
    other = pd.concat(step(iter([pd.DataFrame({"text": texts()[-3:]})])))
    assert other["n"].sum() == sum(len(x[3]) for x in (_links(t) for t in texts()[-3:])) and (other["n"] > 0).all()


def _links(text):
    return None, None, None, [None] * expected([text])[0][3]


@pytest.mark.parametrize("text", ["a b", "a\nb c", "a  b", " a", "a ", "a \nb", "a\n b", "a\n\nb c", "a　b c", "\x1ca b", "a  b", "\n", " "])
def test_units(text):
    """Cut at the spaces between two signs that are not white space, and nowhere else."""
    at = [i for i in range(1, len(text) - 1) if text[i] == " " and not text[i - 1].isspace() and not text[i + 1].isspace()]
    assert alignment.units_of(text) == [text[a:b] for a, b in zip([0, *(i + 1 for i in at)], [*at, len(text)])]
