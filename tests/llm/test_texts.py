"""Encoding, containers and residue."""

import os
import runpy
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glosswork.llm import containers, cues, encode, residue

heldout = SimpleNamespace(**runpy.run_path(str(Path(__file__).with_name("heldout.py"))))

needs_vocabulary = pytest.mark.skipif(not os.path.exists(encode.VOCABULARY), reason="no vocabulary file here")


@pytest.fixture(scope="module")
def reference():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(encode.VOCABULARY)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def encoder():
    return encode.Encoder(encode.VOCABULARY)


def ids_of(encoder, texts):
    ids, ends = encoder.encode(texts)
    return [ids[a:b].tolist() for a, b in zip(ends, ends[1:])]


@needs_vocabulary
@given(st.lists(st.text(max_size=60), max_size=8))
@settings(max_examples=150, deadline=None)
def test_encoding_equals_the_library(encoder, reference, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert ids_of(encoder, texts) == [reference(t) for t in texts]


@needs_vocabulary
def test_long_and_odd_texts(encoder, reference):
    texts = ["a" * 5000, "aaaa" * 3 + "b", " \n\n\t x  ", "<|endoftext|>", "ab" * 2000, "-" * 3000, "naïve 👩‍🔬 日本語 слово", "I'll don't 'S", "\r\n\r\n", "0" * 999]
    assert ids_of(encoder, texts) == [reference(t) for t in texts]


@needs_vocabulary
def test_a_full_store_starts_anew(reference):
    small = encode.Encoder(encode.VOCABULARY, store_words=3)
    for texts in (["one two three four"], ["five six one"], ["seven"]):
        assert ids_of(small, texts) == [reference(t) for t in texts]


@needs_vocabulary
def test_documents(spark, reference):
    rows = [(1, "Hello  world"), (2, None), (3, ""), (4, "  "), (None, "x"), (1, "Hello  world"), (5, "a " * 30000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("ids", F.lit("clash")).withColumn("n_ids", F.lit(1))
    got = [(r["doc_id"], r["ids"]) for r in encode.encode(df).collect()]
    assert sorted(got, key=str) == sorted([(d, reference(t) if t else []) for d, t in rows], key=str)
    counts = [(r["doc_id"], r["n_ids"]) for r in encode.encode(df, counts_only=True).collect()]
    assert sorted(counts, key=str) == sorted([(d, len(i)) for d, i in got], key=str)
    assert encode.encode(df.where("doc_id = 99")).count() == 0
    assert encode.encode(df).schema.simpleString() == "struct<doc_id:bigint,ids:array<int>>"


# -- containers --------------------------------------------------------------


def test_bounds_are_optimal(rng):
    counts = np.zeros(13, np.int64)
    counts[1:] = rng.integers(0, 5, 12)

    def cost(bounds):
        low, total = 0, 0.0
        for b in bounds:
            total += sum(counts[s] * (12 / (12 // b) - s) for s in range(low + 1, b + 1))
            low = b
        return total

    from itertools import combinations

    used = [s for s in range(1, 13) if counts[s]]
    best = min(cost([*c, used[-1]]) for c in combinations(used[:-1], 2))
    assert np.isclose(cost(containers.bucket_bounds(counts, 3)), best)
    assert containers.bucket_bounds(np.zeros(13, np.int64), 3) == []


def placed(spark, sizes, capacity=32, buckets=4):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "doc_id bigint, n_ids bigint").withColumn("piece", F.lit("clash"))
    return containers.fill(df.repartition(3), capacity, buckets)


def test_containers_hold_everything(spark, rng):
    sizes = rng.integers(0, 100, 400).tolist() + [None, 32, 32, 33, 64]
    got = placed(spark, sizes).collect()
    load, parts = {}, {}
    for r in got:
        parts.setdefault(r["doc_id"], []).append(r)
        if r["container"] is None:
            assert r["n_tokens"] == 0 and r["bucket"] is None
        else:
            load[r["container"]] = load.get(r["container"], 0) + r["n_tokens"]
            assert 0 < r["n_tokens"] <= r["bucket"] <= 32
    assert max(load.values()) <= 32 and sorted(load) == list(range(len(load)))
    for i, s in enumerate(sizes):
        mine = sorted(parts[i], key=lambda r: r["piece"])
        assert sum(r["n_tokens"] for r in mine) == (s or 0) and len(mine) == max(1, -(-(s or 0) // 32))
        assert [r["start"] for r in mine] == [32 * k for k in range(len(mine))]
    assert sum(load.values()) / (32 * len(load)) > 0.97
    divided = {r["doc_id"] for r in containers.divided(placed(spark, sizes)).collect()}
    assert divided == {i for i, s in enumerate(sizes) if (s or 0) > 32}


def test_ties_repeats_and_nothing(spark):
    same = placed(spark, [10] * 50).collect()
    assert len({r["container"] for r in same}) == 17
    df = spark.createDataFrame([(None, 5), (1, 5), (1, 5)], "doc_id bigint, n_ids bigint")
    assert containers.fill(df, 32).count() == 3
    none = containers.fill(df.where("n_ids > 9"), 32)
    assert none.count() == 0 and containers.fill_report(none, 32).first()["filled"] is None
    assert containers.fill_report(containers.fill(df, 32), 32).first()["tokens"] == 15


def test_bounds_decide_what_lies_together(rng):
    """Batches form inside a bucket: other bounds give other containers and more space left."""
    counts = np.zeros(257, np.int64)
    np.add.at(counts, np.clip(rng.lognormal(3.2, 1.0, 20_000).astype(int), 1, 256), 1)
    bounds = containers.bucket_bounds(counts, 8)
    _, bare = containers.plan(counts, bounds, topped=False)
    segments, topped = containers.plan(counts, bounds)
    low = dict(zip(bounds, [0, *bounds[:-1]]))
    own = [(s, e, home) for s, _, _, _, e, home in segments.tolist() if s > low[home]]
    assert all(e <= 256 // home for _, e, home in own) and topped < bare
    for other in ([256], [32, 256], sorted({*rng.choice(np.arange(1, 256), 7, replace=False).tolist(), 256})):
        assert containers.plan(counts, other, topped=False)[1] > bare
        assert not np.array_equal(containers.plan(counts, other)[0], segments)
    assert containers.plan(counts, [256])[1] == counts.sum()  # one slot, and nothing shorter to top up with


def test_faults_are_seen(spark):
    sizes = spark.createDataFrame([(1, 40), (2, 8), (3, None), (None, 5)], "doc_id bigint, n_ids bigint")
    whole = containers.fill(sizes, 32, 4)
    assert containers.faults(whole, sizes, 32).first().asDict() == {"documents": 4, "lost": 0, "divided_small": 0, "overfull": 0, "crowded": 0}
    assert containers.faults(whole.where("doc_id <> 2 OR doc_id IS NULL"), sizes, 32).first()["lost"] == 1
    assert containers.faults(whole.withColumn("container", F.lit(0)).withColumn("home", F.lit(32)), sizes, 32).first()["overfull"] == 1
    assert containers.faults(whole.limit(0), sizes.limit(0), 32).first()["documents"] == 0


def test_a_plan_does_not_grow_with_the_items():
    counts = np.zeros(65, np.int64)
    counts[1:] = np.arange(64) * 7 + 3
    bounds = containers.bucket_bounds(counts, 8)
    many, n = containers.plan(counts * 100_000, bounds)
    assert len(np.unique(many[:, 3])) <= 3 * 64  # batches, a few for each length
    used = (many[:, 0] * (many[:, 2] - many[:, 1])).sum()
    assert used == (counts * 100_000 * np.arange(65)).sum() and used / (n * 64) > 0.85


# -- residue -----------------------------------------------------------------

CASES = [
    ("Dear {{first_name}},\nYour order {{order_id}} is {{status}}.\nRegards\n{{team}}", "template"),
    ("Title: [[title]]\nAuthor: [[author]]\nYear: 12", "template"),
    ("[INSERT HEADLINE HERE]\n<your text here>\n[DATE TBD]", "template"),
    ("Name: TBD\nScore: ???\nDate: n.n.", "template"),
    ("Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "filler"),
    ("asdf qwer hjkl asdf test bla xyz", "filler"),
    ("Texte provisoire\n" * 6, "filler"),
    ("test test test test test test test test test", "filler"),
    ("404 Not Found", "error"),
    ("Seite nicht gefunden\nZurück zur Startseite", "error"),
    ("La página no se puede mostrar. Vuelva a intentarlo.", "error"),
    ("Traceback (most recent call last):\n  File \"x.py\", line 3, in f\nKeyError: 'a'", "error"),
    ("页面未找到", "error"),
    ("Please enable JavaScript to view this page.", "script"),
    ("Bitte aktivieren Sie JavaScript, um die Seite anzuzeigen.\n© 2031 Haus", "script"),
    ("Home | About | Login\nEs necesario permitir los scripts y las cookies.", "script"),
    ("Пожалуйста, включите JavaScript в браузере", "script"),
]
CONTENT = [
    "The crawler met status 404 for 12 addresses; those texts are not in the shard. The other shards were counted in full, and the sums agree with the run before.",
    "Pages that only said 'please enable JavaScript' were removed before counting. We kept all others and compared their scores with the older ones at every depth.",
    "Our template has the field {{name}}, which is filled from the run sheet. The values in the table below are final and were checked twice by two readers.",
    "Words such as 'lorem' and 'ipsum' rank high in careless shards, so we track them as cues. The basis stays stable when they are taken out.",
    "for t in tokens:\n    print(f\"{t}: {table[t]}\")\nThe loop prints each token with its value, and the list is sorted by frequency.",
    "alpha: 0.02\nblock: 512\ntokens: 1824903\nwindow = 4\nThe run ended after nine hours.",
    "-" * 160 + "\nThe neighbours of the word are near.\n" + "-" * 160,
]


@pytest.mark.parametrize("text,kind", CASES)
def test_residue_is_found(text, kind):
    assert residue.may_hold_evidence(text)
    total, weight = residue.weigh(text)
    assert 2 * sum(weight.values()) > total and max(weight, key=weight.get) == kind


@pytest.mark.parametrize("text", CONTENT)
def test_content_is_kept(text):
    total, weight = residue.weigh(text)
    assert 2 * sum(weight.values()) <= total


def is_residue(text):
    total, weight = residue.weigh(text)
    return 2 * sum(weight.values()) > total


def test_held_out_texts():
    """Texts written by hand in some twenty languages before the cues were; only faults of word bounds were mended after looking at them."""
    found = [is_residue(t) for t in heldout.RESIDUE]
    false = [is_residue(t) for t in heldout.CONTENT]
    assert len(found) >= 60 and len(false) >= 60
    assert sum(found) >= 0.95 * len(found) and sum(false) <= 0.05 * len(false)
    assert all(residue.may_hold_evidence(t) for t, f in zip(heldout.RESIDUE, found) if f)


def pages(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    return df.withColumn("kind", F.lit("clash")).withColumn("line", F.lit(1)).withColumn("share", F.lit(0)).repartition(3)


def test_boilerplate_leaves_the_residual(spark):
    note = "Please enable JavaScript to go on."
    menu = "Kiosk Harbour Weather Trams of the old town"
    rows = [(1, "h1", f"{menu}\n{note}"), (2, "h1", f"{menu}\nA text about the harbour."), (3, "H1 ", f"{menu}\nThe trams run until nine."), (4, "h2", f"{menu}\n{note}"), (5, None, f"{menu}\n{note}")]
    rows += [(6, "h1", None), (7, "h1", ""), (8, "h1", " \n "), (None, "h1", note), (9, "h3", note), (9, "h3", note)]
    df = pages(spark, rows)
    got = [(r["doc_id"], r["kind"], round(r["share"], 3)) for r in residue.residue(df).collect()]
    assert sorted(got, key=str) == sorted([(1, "script", 1.0), (None, "script", 1.0), (9, "script", 1.0), (9, "script", 1.0)], key=str)
    assert residue.residue(df.where("doc_id = 99")).count() == 0
    counts = {(r["source"], r["line"]): r["docs"] for r in residue.line_counts(residue.lines_of(df.where("doc_id <> 9 OR doc_id IS NULL"))).collect()}
    assert sorted(counts.values()) == [1, 1, 1, 1, 1, 1, 2, 3] and max(counts, key=counts.get)[0] == "h1"
    # without the other pages of its host the same document is not residue
    assert residue.residue(df.where("doc_id IN (1, 4)")).count() == 0


def test_recurrent_lines_are_learnt(spark):
    """A line in no known form that recurs only beside errors is evidence; one that recurs beside content is not."""
    odd, usual = "Quendra molvi testrape indoru valke", "The harbour office is open from nine to five"
    rows = [(i, f"h{i}", f"Error {500 + i % 2}: page not found, sorry about that\n{odd}") for i in range(14)]
    rows += [(20 + i, f"h{i}", f"{usual}\nA note of its own about boat number {'x' * i} in the harbour") for i in range(8)]
    rows += [(50, "h9", odd), (51, "h9", odd), (52, "h9", f"{odd}\nA long text about the boats that lay in the harbour for weeks."), (53, "h9", usual)]
    got = {r["doc_id"] for r in residue.residue(pages(spark, rows)).collect()}
    assert got == {*range(14), 50, 51}


def test_very_long_texts_are_judged_whole():
    body = "The harbour lies in the north and the trams go there every day. " * 4000
    total, weight = residue.weigh(body + "\nPlease enable JavaScript.")
    assert 2 * sum(weight.values()) <= total
    total, weight = residue.weigh("Please enable JavaScript to go on.\n" * 4000 + body[:500])
    assert 2 * sum(weight.values()) > total


@given(st.text(max_size=200))
@settings(max_examples=150, deadline=None)
def test_any_text_can_be_weighed(text):
    total, weight = residue.weigh(text)
    assert 0 <= sum(weight.values()) <= total
    if 2 * sum(weight.values()) > total:
        assert residue.may_hold_evidence(text)


FILLER_TEXTS = [
    "foo bar baz qux bla test",
    "bla bla bla bla",
    "sample text 12 test word 7",
    "First card title. Second card title. Image caption. A short teaser for this card.",
    "First card title. Second card title. Image caption. Button label. List item one. A short teaser for this card.",
]


@pytest.mark.parametrize("text", FILLER_TEXTS)
def test_filler_of_common_words_passes_the_first_look(text):
    assert residue.may_hold_evidence(text)
    total, weight = residue.weigh(text)
    assert total and weight["filler"] == total


_PIECE = st.sampled_from(["foo", "bar", "test", "word", "text", "bla", "sit", "12", "harbour", "the", "trams", "image caption.", "card title,", "read more", "/", "|", "•", "tbd", "error: 404", "{x}", "impressum", "%a%", "...", "page not found.", "\n", "İ", "«Name_x»", "cookies", "please", "lorem ipsum dolor"])


@given(st.lists(_PIECE, min_size=1, max_size=90))
@settings(max_examples=300, deadline=None)
def test_the_first_look_passes_all_that_is_not_content(pieces):
    text = " ".join(pieces)
    _, weight = residue.weigh(text)
    assert not weight or residue.may_hold_evidence(text)


def test_repetition():
    again = ["bla bla bla bla bla bla bla bla", "One line.\nOne line.\nOne line.", "a. b. a. c. a. d", "Nobody knows. Nobody knows. Nobody knows!", "The same again and again.\n" * 500]
    assert all(residue.repeats(t) for t in again)
    assert not any(residue.repeats(t) for t in ["The boats lie in the harbour. The trams go by.", "", " \n ", "x", "\ud800"])


def test_cues_hold_at_word_bounds():
    assert any(b & cues.THING for _, b in cues.of("the page")) and not any(b & cues.THING for _, b in cues.of("opposite rampage"))
    assert any(b & cues.SCRIPT for _, b in cues.of("はjavascriptを")) and any(b & cues.NOT for _, b in cues.of("it can't be"))
    at, bits = cues.hits("page not found\0the page")
    assert [(int(a), int(b)) for a, b in zip(at, bits)] == sorted((a, b) for a, b in [*cues.of("page not found"), *((a + 15, b) for a, b in cues.of("the page"))])
