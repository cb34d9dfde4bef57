"""Operators on single documents: edge cases, brute force, held-out accuracy."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.feature import CountVectorizerModel

from tests.conftest import SF_SMALL
from vulnlake.llm import attention, decontaminate, html, licences, lm, mixing, quality, sharding, toxicity
from vulnlake.sources.views import table


# ---------------------------------------------------------------- mixing, sharding

def test_water_filling_clamps_and_reshares(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 100), (None, 1000), ("é", 0)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    # weights: a 3, b 1, c 2, é 3, null 1; a, c and é stop at their caps, b and null share the rest
    assert got == {"a": 20.0, "c": 200.0, "é": 0.0, "b": pytest.approx(1472.5), None: pytest.approx(1472.5)}
    assert sum(got.values()) == pytest.approx(1.5 * 2110)


def test_mix_meets_targets_with_edge_rows(spark, make_docs, words):
    rows = [(k, words(1 + k % 50, k), "big") for k in range(300)] + [(1000 + k, words(7, k), "small") for k in range(3)]
    rows += [(2000, None, "none"), (2001, "", None), (2002, "\t", "big"), (None, "x y", "big"), (5, words(6, 5), "big")]
    docs = make_docs(rows)
    out = mixing.mix(spark, docs).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        assert 0 <= r.taken <= 2 * r.size
        by.setdefault(r.source, [r.target, 0])[1] += r.taken
    assert all(abs(t - k) <= 0.5 for t, k in by.values())
    assert Counter(map(str, out)) == Counter(map(str, mixing.mix(spark, docs).collect()))
    repeated = mixing.repeat_documents(spark, docs)
    assert repeated.columns == docs.columns
    times = Counter(r.doc_id for r in repeated.collect())
    assert times[2000] == times[2001] == times[2002] == 1 and max(times.values()) <= 4
    assert mixing.mix(spark, make_docs([])).count() == 0 and mixing.repeat_documents(spark, make_docs([])).count() == 0


def test_shards_are_even_gapless_and_survive_hot_keys(spark, make_docs, words):
    rows = [(k, "same text here") for k in range(800)] + [(1000 + k, words(1 + k % 40, k)) for k in range(800)]
    rows += [(None, None), (7, ""), (7, "")] + [(9_999, "again")] * 300
    out = sharding.document_shards(spark, make_docs(rows)).collect()
    assert len(out) == len(rows)
    bytes_, slots = Counter(), {}
    for r in out:
        bytes_[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert sorted(bytes_) == list(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(bytes_.values()) - min(bytes_.values()) <= 2 * max(r.size for r in out)
    assert {r.text_crc32 for r in out if r.doc_id == 9_999} == {zlib.crc32(b"again")}
    assert sharding.document_shards(spark, make_docs([])).count() == 0
    placed = sharding.shard_documents(spark, make_docs(rows))
    assert placed.count() == len(rows) and {r.shard for r in placed.select("shard").distinct().collect()} <= set(range(24))


# ---------------------------------------------------------------- quality

def brute_quality(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [tuple(w[i: i + 8]) for i in range(len(w) - 7)]
    n = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(8)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_document_stats_equal_brute_force(spark, make_docs, words):
    r = random.Random(1)
    texts = [None, "", " ", "a", "\n\n", "a\na\n a\na", words(20_000, 3, 50), "é\x0b#\x1c x y \r\n|<>", "x " * 500, "\n".join([words(9, 1)] * 4)]
    texts += [" ".join(r.choice("ab") for _ in range(r.randrange(60))) for _ in range(60)]
    rows = list(enumerate(texts))
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.document_stats(make_docs(rows)).collect()}
    assert got == {i: brute_quality(t) for i, t in rows}


def test_host_verdicts_reach_their_documents(spark, make_docs, words):
    rows = [(k, words(30, k), "good") for k in range(40)] + [(100 + k, "bad" if k < 38 else words(30, k), "bad") for k in range(40)]
    rows += [(200, words(30, 999), None), (None, None, None), (202, words(30, 998), "tiny")]
    out = {r.doc_id: r for r in quality.judge(spark, make_docs(rows)).collect()}
    assert all(out[k].kept for k in range(40)) and out[202].kept and out[200].kept and not out[None].kept
    assert not any(out[100 + k].kept for k in range(40)) and not out[139].base_failed
    assert quality.judge(spark, make_docs([])).count() == 0


# ---------------------------------------------------------------- toxicity

def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_equals_edit_distance():
    terms = {"idiot": (False, 1.0), "scum": (False, 1.0), "worthless": (False, 0.8), "stupid": (False, 0.5), "lowe": (True, 0.7)}
    lexicon, r = toxicity.FuzzyLexicon(terms), random.Random(7)
    for _ in range(4_000):
        w = list(r.choice([*terms, "random", "word"]))
        for _ in range(r.randrange(4)):
            k = r.randrange(len(w) + 1)
            w[k: k + r.randrange(2)] = r.choice(["", "a", "t", "s"])
        w = "".join(w)
        want = 0.0
        for t, (stem, weight) in terms.items():
            d = edit_distance(w, t)
            if stem and w.startswith(t):
                want = max(want, weight)
            elif not stem and d <= toxicity.edits_allowed(t):
                want = max(want, weight * toxicity.EDIT_WEIGHT[d])
        assert lexicon._match(w) == want, w


def test_quotation_weighs_less_than_abuse():
    lexicon = toxicity.FuzzyLexicon({"idiot": (False, 1.0)})
    plain, quoted, you = (toxicity.evidence(t, lexicon)[0] for t in ("he is an idiot indeed", 'he said "idiot" to them', "you are an idiot indeed"))
    assert quoted < plain < you
    assert toxicity.evidence("an 1diot and an idi0t", lexicon)[0] > 0
    assert toxicity.evidence(None, lexicon)[:3] == (0.0, 0.0, 0) and toxicity.evidence("", lexicon)[:3] == (0.0, 0.0, 0)


def test_toxicity_held_out_accuracy_and_edges(spark, make_docs, words):
    r = random.Random(3)
    rows, labels = [], []
    for k in range(600):
        bad = k % 5 == 0
        w = words(60, k, 10**6).split()
        if bad:
            for _ in range(2):
                w.insert(r.randrange(len(w)), r.choice(["idiot", "scum", "worthless"]))
        rows.append((k, " ".join(w)))
        labels.append((k, 1, int(bad)))
    rows += [(1000, None), (1001, ""), (None, "idiot"), (1002, words(50_000, 5)), (1003, words(30, 6) + " w0rthless idiott " + words(30, 7))]
    labels += [(None, 1, 1), (5, 0, None), (0, 1, 1)]
    docs, known = make_docs(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(spark, docs, known)
    out = {r.doc_id: r for r in toxicity.score(spark, docs, model).collect()}
    assert set(model.terms) == {"idiot", "scum", "worthless"}
    held = [k for k in range(600) if out[k].held_out]
    assert 150 < len(held) < 250 and all(out[k].predicted == (k % 5 == 0) for k in held)
    assert out[1000].score == out[1001].score < 0.5 and out[1003].predicted == 1 and not out[1002].predicted
    kept = {r.doc_id for r in toxicity.keep_clean(spark, docs, model).collect()}
    assert kept == {i for i, r in out.items() if not r.predicted}
    none = toxicity.train(spark, docs, known.limit(0))
    assert {r.score for r in toxicity.score(spark, docs.limit(5), none).collect()} == {0.5} or none.weights[0] < 0
    assert toxicity.score(spark, make_docs([]), model).count() == 0


def test_copies_and_large_samples_raise_no_bar(spark, words):
    r = random.Random(5)

    def having(k, *terms):
        w = words(40, k, 10**6).split()
        for t in terms:
            w.insert(r.randrange(len(w)), t)
        return " ".join(w)

    rows = [(1, having(k, "wretch")) for k in range(1000)]  # many toxic texts, and 15 with a rarer term
    rows += [(1, having(5000 + k, "vermin")) for k in range(15)]
    rows += [(1, "common words of a copied text with you foulness in it")] * 900 + [(1, f"you foulness {words(2, k)}") for k in range(60)]
    rows += [(1, f"copied again and seldom numbered at its end {k}") for k in range(400)]
    rows += [(0, having(9000 + k, *(["seldom"] if k % 50 == 0 else []))) for k in range(2000)]
    terms = toxicity.learn_lexicon(spark.createDataFrame(rows, "toxic int, text string"))
    assert {"wretch", "vermin", "foulness"} <= set(terms) and "seldom" not in terms
    assert not {"common", "copied", "numbered"} & set(terms)


def test_words_of_a_stem_are_found_misspelled(spark, words):
    family = ["wretched", "wretches", "wretchings"]
    rows = [(1, f"{words(10, k, 10**6)} {family[k % 3]} {words(10, k + 500, 10**6)}") for k in range(240)] + [(0, words(21, k + 2000, 10**6)) for k in range(500)]
    terms = toxicity.learn_lexicon(spark.createDataFrame(rows, "toxic int, text string"))
    assert any(stem for stem, _ in terms.values()) and set(family) <= set(terms)
    lexicon = toxicity.FuzzyLexicon(terms)
    assert all(lexicon.find(w) > 0 for w in ("vretched", "wrotches", "wrwtchings", "wretchedly")) and not lexicon.find("watches")


# ---------------------------------------------------------------- decontamination

ITEM = "If a train leaves Boston at 60 km per hour and needs 3 hours to reach Albany how far away is Albany from Boston in all"


def test_templates_catch_other_numbers_and_names(spark, make_docs, words):
    same = f"{words(40, 1)}. {ITEM} {words(40, 2)}"
    other = f"{words(30, 3)}. {ITEM.replace('Boston', 'Paris').replace('Albany', 'Lyon').replace('60', '85').replace('3', '7')}. {words(9, 4)}"
    mixed_up = f"{words(30, 3)}. " + ITEM.replace("Boston", "Paris", 1).replace("Albany", "Paris", 1).replace("60", "85") + ". end"
    rows = [(1, same), (2, other), (3, words(200, 5)), (4, None), (5, ""), (6, mixed_up), (7, "short one"), (7, "short one"), (None, same), (8, "short one more")]
    bench = spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (4, "short one"), (5, "and here are some other words that nobody has written down")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.coverage for r in decontaminate.contaminated(spark, make_docs(rows), bench).collect()}
    assert set(got) == {(1, 1), (2, 1), (7, 4), (None, 1)} and got[1, 1] > 0.9 and got[2, 1] > 0.9
    docs = make_docs(rows)
    clean = decontaminate.keep_uncontaminated(spark, docs, bench)
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == [3, 4, 5, 6, 8]
    assert decontaminate.contaminated(spark, make_docs([]), bench).count() == 0
    assert decontaminate.contaminated(spark, docs, bench.limit(0)).count() == 0


def test_without_the_filter_the_join_finds_the_same(spark, make_docs, words, monkeypatch):
    rows = [(k, f"{words(20, k)}. {ITEM if k % 3 == 0 else words(20, k + 50)} {words(20, k + 99)}") for k in range(12)]
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    small = sorted(map(str, decontaminate.contaminated(spark, make_docs(rows), bench).collect()))
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    assert sorted(map(str, decontaminate.contaminated(spark, make_docs(rows), bench).collect())) == small and len(small) == 4


def test_items_of_numbers_and_capitals_are_found_verbatim(spark, make_docs, words):
    items = ["Calculate 12 + 7 - 3 * 4 / 2 + 9 - 5", "The Old Man And The Sea By Ernest Hemingway Won The Pulitzer Prize For Fiction In 1953",
             "What is the capital of the French republic", "Das Haus der Familie Meier am Rande der Stadt Bonn hat einen Garten mit Apfel Birne Kirsche und Pflaume"]
    rows = [(k, f"{words(30, k)} {item} {words(30, k + 50)}") for k, item in enumerate(items)]
    rows += [(100, f"{words(30, 7)}. Calculate 13 + 8 - 4 * 5 / 3 + 8 - 6"), (101, "Calculate 3"), (102, f"{words(30, 8)} Calculate 12 + 7 - 3")]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.coverage for r in decontaminate.contaminated(spark, make_docs(rows), bench).collect()}
    assert set(got) == {(k, k) for k in range(4)} and all(c > 0.85 for c in got.values()), got


def test_replacements_of_other_lengths_and_inserted_words(spark, make_docs, words):
    names = f"{words(30, 1)}. {ITEM.replace('Boston', 'New York').replace('Albany', 'Rio')}. {words(9, 2)}"
    parts = [words(10, k) for k in (11, 12, 13)]
    apart = f"{words(30, 4)}. {parts[0]} and so {parts[1]} twenty five {parts[2]}. {words(9, 5)}"
    swapped = f"{words(30, 4)}. {parts[2]} and so {parts[0]}. {words(9, 5)}"
    rows = [(1, names), (2, apart), (3, f"{parts[0]} {words(500, 6)}"), (4, swapped)]
    bench = spark.createDataFrame([(1, ITEM), (2, f"{parts[0]} {parts[1]} 5 {parts[2]}")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_tokens, r.n_covered) for r in decontaminate.contaminated(spark, make_docs(rows), bench).collect()}
    assert got == {(1, 1): (26, 26), (2, 2): (31, 30)}


def test_pieces_of_a_chain_agree_and_keep_their_order():
    def piece(a, b, c, **values):
        return decontaminate.Piece(a, b, c, c + b - a, values, {v: k for k, v in values.items()}, b - a, 1)

    assert decontaminate.chained([piece(0, 10, 5, x="1"), piece(12, 20, 30, x="1", y="2")]) == (18, 2)
    assert decontaminate.chained([piece(0, 10, 5, x="1"), piece(12, 20, 30, x="2")]) == (10, 1)
    assert decontaminate.chained([piece(0, 10, 50), piece(12, 20, 30)]) == (10, 1)
    assert decontaminate.chained([piece(0, 10, 5), piece(8, 20, 15)]) == (20, 2)
    assert decontaminate.chained([]) == (0, 0)


def test_slot_consistency():
    assert decontaminate.consistent([(["60", "boston"], ["85", "paris"]), (["boston", "3"], ["paris", "7"])]) == [True, True]
    assert decontaminate.consistent([(["60", "boston"], ["85", "paris"]), (["boston"], ["rome"])]) == [True, False]
    assert decontaminate.consistent([(["a", "b"], ["x", "x"])]) == [False]


# ---------------------------------------------------------------- HTML

PAGE = """<html><body><header><h1>Site</h1></header><div id="cookie-notice"><p>We use cookies, a very long notice indeed, accept it please.</p></div>
<nav><ul><li><a href="/x">x</a><li><a>y</a></ul></nav>{open}<h2>A &lt;title&gt;</h2><p>First paragraph with <b>bold</b>
 words &amp; more,&nbsp;long enough.</p><p>Short.<div class="advert">buy now</div><p>Third one closes it here with a few words.</p>
<form><label>Mail</label><input></form><script>var t = "</p><p>no";</script>{close}<aside>Something else that is fairly long and annoying for us all.</aside>
<section id="comments"><article class="comment"><p>I am a reader and write a very long comment on it.</p></article></section><footer>&copy; x</footer></body></html>"""
TEXT = "A <title>\nFirst paragraph with bold words & more, long enough.\nShort.\nThird one closes it here with a few words."


@pytest.mark.parametrize("open_, close", [("<article>", "</article>"), ('<div class="content">', "</div>"), ("<main>", "</main>"), ("", "")])
def test_article_between_surge_and_dive(open_, close):
    assert html.main_text(PAGE.format(open=open_, close=close)) == TEXT


def test_one_long_paragraph_keeps_the_others():
    lines = [f"{k} " + "short text " * 9 for k in range(12)]
    lines[6] = "long text " * 300
    lines = [" ".join(x.split()) for x in [*lines, "So it ends.", "Bye."]]
    page = "<html><body><nav>menu</nav>" + "".join(f"<p>{x}</p>" for x in lines) + "<ul><li><a href='/'>all</a></li></ul><footer>foot</footer></body></html>"
    assert html.main_text(page) == "\n".join(lines)


@pytest.mark.parametrize("attrs", ["class='content has-sidebar'", "class='page no-comments'", "class='social site'", "id=header"])
def test_hints_on_the_wrapper_of_the_page(attrs):
    page = f"<body><div {attrs}><p>{'some words here ' * 9}</p><div class='sidebar'>aside text</div><p>{'more words here ' * 9}</p></div><div id=comments><p>nice</p></div></body>"
    assert html.main_text(page) == f"{'some words here ' * 9}".strip() + "\n" + f"{'more words here ' * 9}".strip()
    assert html.main_text(f"<body><p>A short piece of text.</p><div class='comments'><p>{'a long comment ' * 50}</p></div></body>") == "A short piece of text."


def test_html_edges(spark):
    assert [html.main_text(x) for x in (None, "", "   ", "<p></p>", "<script>x", "<!-- a", "<nav>menu</nav>")] == [""] * 7
    assert html.main_text("plain words") == "plain words" and html.main_text("<p>a < b and c</p>") == "a < b and c"
    long = "<p>word " * 20_000
    assert html.main_text(long).count("\n") == 19_999
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, "x")], "page_id long, url string, html string, text string")
    pages = pages.withColumnRenamed("text", "n_chars")
    assert sorted((r.page_id or 0, r.n_chars) for r in html.extract(spark, pages).collect())[0] == (0, 0)
    assert html.extract(spark, pages.limit(0)).count() == 0


def test_pages_of_the_table(spark):
    rows = html.extract(spark, table(spark, SF_SMALL, "pages")).join(table(spark, SF_SMALL, "pages").select("page_id", "html"), "page_id").collect()
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        import html as entities
        blocks = [" ".join(entities.unescape(re.sub(r"</?b>|<br>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


# ---------------------------------------------------------------- licences

def test_every_template_is_anchored_and_found(spark, make_docs, words):
    assert [t for ts in licences.TEMPLATES.values() for t in ts if not re.search(licences.ANCHORS[4:], t, re.I)] == []
    rows = [(k, words(60, k)) for k in range(300)]
    rows += [(1000, f"{words(5, 1)}\nReleased under the GPL.\n{words(5, 2)}"), (1001, "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited.")]
    got = {(r.doc_id, r.paragraph): r.family for r in licences.scan(spark, make_docs(rows)).collect()}
    assert got == {(1000, 1): "GPL", (1001, 0): "Proprietary"}


def test_a_notice_line_without_a_licence_word_is_named(spark, make_docs, words):
    rows = [(k, words(60, k)) for k in range(300)]
    rows += [(1000, "This Source Code Form is subject to the terms of the Mozilla Public\n" + words(9, 3))]
    assert not re.search(licences.ANCHORS[4:], rows[-1][1], re.I)
    got = [(r.doc_id, r.paragraph, r.family) for r in licences.scan(spark, make_docs(rows)).collect()]
    assert got == [(1000, 0, "MPL")]


def test_licence_families_and_unknown(spark, make_docs, words):
    rows = [(k, words(60, k)) for k in range(300)]
    rows += [(1000, f"{words(5, 1)}\nReleased under the MIT License.\n{words(5, 2)}"), (1001, "Licensed under the Apache License, Version 2.0."),
             (1002, "My driving license came with the permission of my parents."), (1003, None), (1004, ""), (None, "Licensed under CC BY-NC 4.0."),
             (1005, "This file is part of it. Licensed under the GNU Affero General Public License version 3, see below."), (1001, "Licensed under the Apache License, Version 2.0.")]
    docs = make_docs(rows)
    scanner = licences.train(spark, docs)
    got = Counter((r.doc_id, r.paragraph, r.family) for r in licences.scan(spark, docs, scanner).collect())
    assert got == Counter({(1000, 1, "MIT"): 1, (1001, 0, "Apache"): 2, (1002, 0, "unknown"): 1, (None, 0, "CC-BY-NC"): 1, (1005, 0, "AGPL"): 1})
    assert licences.scan(spark, make_docs([]), scanner).count() == 0


def test_all_paragraphs_without_a_licence_word_train_the_unknown_class(spark, make_docs, words):
    """Every line of every document, also of more than any sample holds; equal vectors are counted, copies of a row too."""
    rows = [(k, "\n".join(f"{words(3, 20 * k + j)} the terms" if j % 2 else f"use of the work {j}" for j in range(20))) for k in range(450)]
    rows += [(1000, "Licensed under the MIT License.\n\nfree software"), (1001, None), (None, "free software"), (None, "free software"), (1002, "")]
    vectorizer = CountVectorizerModel.from_vocabulary(licences._vocabulary(), inputCol="grams", outputCol="features")
    found = licences.unknown_vectors(spark, make_docs(rows), vectorizer.setBinary(True)).collect()
    assert sum(r.n for r in found) == 9_003 and {r.half for r in found} == {0, 1}
    assert len(found) <= 2 * len({tuple(r.features.indices) for r in found})
    free = sorted(vectorizer.vocabulary.index(x) for x in ("free", "software", "free software"))
    assert sum(r.n for r in found if list(r.features.indices) == free) == 3


def test_the_cheap_strings_of_licence_words_miss_none(spark):
    texts = ["LICENCE", "a Licensee", "CopyRight", "COPYLEFT", "spdx-id", "warranty", "Redistribution", "public  domain", "Public Domain", "All rights reserved", "permissions", "GNU's",
             "gnus", "Creative Commons", "cc0", "acc0", "CC BY", "cc-by-4", "accby", "AGPL", "lgplv3", "egpl", "Proprietary", "unauthorised copying", "Unauthorized Copying", "İ licensé", "ſpdx", "plain"]
    rows = licences.read(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.body: r.anchored for r in rows} == {x: bool(re.search(licences.ANCHORS[4:], x, re.I | re.A)) for x in texts}


# ---------------------------------------------------------------- language model

def test_every_training_token_is_in_one_window(spark, make_docs):
    sizes = [0, 1, 31, 32, 33, 200]
    docs = make_docs([(n, " ".join(["word"] * n)) for n in sizes]).selectExpr("*", "0.25D AS u")
    rows = lm.training_windows(docs, lm._ranks(lm.TOKENIZER)).collect()
    # predicted: every word and every end, once
    assert sum(x != -2 for r in rows for x in r.firsts[1:]) == sum(sizes) + len(sizes)
    assert sum(x == -1 for r in rows for x in r.firsts[1:]) == len(sizes)
    assert sum(r.firsts[0] == -1 for r in rows) == len(sizes) and all(0 <= r.u < 1 and len(r.firsts) == lm.LENGTH + 1 == len(r.lasts) for r in rows)


def test_attention_gradients():
    model, rng = attention.Attention(7, 5, 6, width=4, hidden=5, seed=1), np.random.default_rng(2)
    x1, x2, y = rng.integers(0, 7, (3, 6)), rng.integers(0, 5, (3, 6)), rng.integers(0, 7, (3, 6))
    live = rng.random((3, 6)) < 0.8
    loss = lambda: -(model.log_probs(x1, x2, y) * live).sum() / live.sum()
    before = {k: v.copy() for k, v in model.p.items()}
    model.step(x1, x2, y, live, 0.0)
    grads = {k: m / 0.1 for k, (m, _) in model.moments.items()}
    for name, value in before.items():
        for _ in range(3):
            at = tuple(rng.integers(0, s) for s in value.shape)
            keep = value[at]
            model.p[name] = value.copy()
            ends = []
            for d in (1e-2, -1e-2):
                model.p[name][at] = keep + d
                ends.append(loss())
            model.p[name] = value
            assert (ends[0] - ends[1]) / 2e-2 == pytest.approx(grads[name][at], abs=3e-3)


def test_attention_sees_no_later_token():
    model = attention.Attention(7, 5, 6, seed=1)
    x = np.array([[1, 2, 3, 4, 5, 6]])
    changed = x.copy()
    changed[0, 4:] = 0
    a, b = (model.log_probs(v, v % 5, np.array([[1, 1, 1, 1, 1, 1]])) for v in (x, changed))
    assert np.allclose(a[0, :4], b[0, :4]) and not np.allclose(a[0, 4:], b[0, 4:])


def test_scores_are_proper_and_both_joins_agree(spark, make_docs, words):
    rows = [(k, words(1 + k * 7 % 90, k, 60) + " unseen%d" % k) for k in range(80)] + [(500, None), (501, ""), (None, "W1 w1"), (503, words(5_000, 9, 80))]
    docs = make_docs(rows)
    got = {r.doc_id: r for r in lm.score(spark, docs).collect()}
    tokens = {i: [w.lower() for w in (t or "").split()] + [None] for i, t in rows}
    held = {i: zlib.crc32(str(i if i is not None else "").encode()) % 10 == 0 for i in tokens}
    c = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n = sum(c.values())
    for i, ws in tokens.items():
        r = got[i]
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (len(c) + 1))) for w in ws)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(base) and math.isfinite(r.score) and r.score < 0
    shuffled = {r.doc_id: r for r in lm.score(spark, docs, broadcast_words=0).collect()}
    assert all(shuffled[i].n_known == r.n_known and shuffled[i].score == pytest.approx(r.score, rel=1e-6) and shuffled[i].base_score == pytest.approx(r.base_score)
               for i, r in got.items())
    assert lm.score(spark, make_docs([])).count() == 0


def test_a_step_reuses_its_arrays_and_equals_the_plain_sums():
    """Sums by class, grouped products and arrays written anew leave nothing of the call before."""
    rng = np.random.default_rng(4)
    rows, classes = rng.normal(size=(256, 3)).astype(np.float32), rng.integers(0, 9, 256).astype(np.int16)
    assert np.allclose(attention._sums(rows, classes, 11), np.eye(11)[classes].T @ rows, atol=1e-4)
    left, right = rng.normal(size=(8, 32, 4)), rng.normal(size=(8, 32, 5))
    assert np.allclose(attention._outer(left, right), left.reshape(-1, 4).T @ right.reshape(-1, 5))
    batches = [tuple(rng.integers(0, 5, (n, 6)) for _ in range(3)) for n in (4, 3, 4)]
    used, fresh = (attention.Attention(7, 5, 6, seed=1) for _ in range(2))
    for x1, x2, y in batches:
        fresh.rooms.clear()
        for model in (used, fresh):
            model.step(x1, x2, y, np.ones(y.shape, bool), 0.01)
    assert np.array_equal(used.vector(), fresh.vector()) and set(used.rooms) == set(fresh.rooms)
    at = {name: id(room) for name, room in used.rooms.items()}
    used.step(*batches[0], np.ones((4, 6), bool), 0.01)
    assert {name: id(room) for name, room in used.rooms.items()} == at


def test_large_logits_neither_overflow_nor_vanish():
    model = attention.Attention(7, 5, 6, seed=1)
    model.p["b"] = np.array([500, -500, 0, 0, 0, 0, 0], np.float32)
    model.p["q"] = model.p["q"] * 1e4
    x = np.array([[1, 2, 3, 4, 0, 1]])
    assert np.allclose(model.log_probs(x, x, np.zeros_like(x)), 0) and np.isfinite(model.log_probs(x, x, x)).all()


def test_words_are_cut_and_encoded_together(spark, make_docs):
    """Many words at once get the ids of each alone; words of foreign spaces only have ids too."""
    texts = ["  The caf\u00e9 the\tTHE\n", None, "", " ", "a\u00a0b \u3000 x\u2003 \ufffd z\x1fy \u0085", "ÀB the"]
    words = lm.Numbered()
    numbers, sizes = words.of(pa.array(texts, pa.string()))
    plain = [(t or "").encode().lower().split() for t in texts]
    assert sizes.tolist() == [len(w) for w in plain] and [list(words)[i] for i in numbers] == [w for ws in plain for w in ws]
    cut, all_words = lm.subwords(lm._ranks(lm.TOKENIZER)), [*words, b"\xff\xfe", "\u3000".encode()]
    assert cut.of(all_words).tolist() == [list(cut(w)) for w in all_words] and cut.of([]).shape == (0, 2)
    got = {r.doc_id: r for r in lm.score(spark, make_docs(list(enumerate(texts)))).collect()}
    assert [got[i].n_tokens - 1 for i in range(len(texts))] == [len(w) for w in plain] and all(math.isfinite(r.score) for r in got.values())


def test_model_beats_the_base_on_held_out_documents(spark):
    rows = lm.score(spark, table(spark, SF_SMALL, "documents")).where("held_out").collect()
    assert rows and sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_scorer_learns_a_batch_at_once(monkeypatch):
    """New words are looked up together, known ones not again; a run's scorer stays with its worker."""
    ranks = lm._ranks(lm.TOKENIZER)
    cut, calls, plain = lm.subwords(ranks), [], lm.Scorer._learn
    monkeypatch.setattr(lm.Scorer, "_learn", lambda self, new: calls.append(new) or plain(self, new))
    counted = lm._hashes([b"one", b"two"])
    order = np.argsort(counted)
    classes = lm.Classes([cut(b"one")[0]], [cut(b"two")[1]])
    make = lambda: lm.Scorer(ranks, classes, lm._model().vector(), (counted[order], np.array([7, 8])[order]))
    scorer = lm.kept_scorer("run", make)
    assert [x.tolist() for x in scorer.ids(["One two", None, "", "three two"])] == [[0, 1], [], [], [2, 1]]
    assert [x.tolist() for x in lm.kept_scorer("run", make).ids(["two one"])] == [[1, 0]]
    assert calls == [[b"one", b"two", b"three"]] and scorer.count.tolist() == [7, 8, 0]
    assert [scorer.first[0], scorer.last[1]] == [2, 2] and scorer.first.dtype == np.int16
    monkeypatch.setattr(lm, "_CACHE", 2)
    assert [x.tolist() for x in scorer.ids(["four two"])] == [[0, 1]] and scorer.count.tolist() == [0, 8]
    assert lm.kept_scorer("other", make) is not scorer
