"""Tokenizer, packing and subjects: round trips, brute force and held-out labels."""

from pathlib import Path

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from partloom.llm import packing, subjects, tokenizer
from partloom.session import table

FOLDER = tokenizer.TOKENIZERS


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{FOLDER}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


@pytest.fixture(scope="module")
def vocabulary():
    return tokenizer.Vocabulary(Path(FOLDER, "byte_bpe_50k.tiktoken").read_bytes())


@settings(max_examples=150, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(max_size=60))
def test_any_text(vocabulary, reference, text):
    ids = [int(i) for i in vocabulary.encode_batch([text])[0]]
    assert ids == reference.encode(text, add_special_tokens=False).ids
    assert b"".join(vocabulary.text[i] for i in ids).decode() == text


def test_awkward_texts(vocabulary, reference):
    texts = ["", None, "a" * 20_000, " " * 5000, "aaaa aaa aaaaaaa", "<|endoftext|> x", "日本語のテキスト 👍🏽", "\n\n\t x  y ", "don't they'll", "Ünïcödé" * 50, "0123456789" * 30]
    got = vocabulary.encode_batch(texts)
    assert [list(map(int, x)) for x in got] == [reference.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_given_documents(spark, reference):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    got = tokenizer.p8_ids(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(rows) and all(r["ids"] == reference.encode(rows[r["doc_id"]] or "", add_special_tokens=False).ids for r in got)


def test_nulls_repeats_and_clashing_names(spark):
    df = spark.createDataFrame([(1, None, 1), (1, None, 1), (None, "x", 2), (3, "", 3)], "doc_id long, text string, ids int")
    out = tokenizer.token_ids(df)
    assert out.columns == ["doc_id", "ids"] and sorted(len(r["ids"]) for r in out.collect()) == [0, 0, 0, 1]
    assert tokenizer.token_ids(df.limit(0)).count() == 0
    assert [r["n_tokens"] for r in tokenizer.token_counts(df).orderBy("n_tokens").collect()] == [0, 0, 0, 1]


def test_packing_places_everything(spark):
    rows = [(i, (i * 37) % 200) for i in range(400)] + [(1000, 950), (1001, 300), (1002, None), (1003, -5), (7, 7), (None, 10)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, n_tokens long, container_id string")
    out = packing.pack(df, 300, containers_per_shard=40).collect()
    used, whole = {}, {}
    for r in out:
        used[r["container_id"]] = used.get(r["container_id"], 0) + r["n_tokens"]
        whole[r["doc_id"]] = whole.get(r["doc_id"], 0) + r["n_tokens"]
    assert max(used.values()) <= 300
    sizes = {}
    for k, n in rows:
        sizes[k] = sizes.get(k, 0) + max(0, n or 0)
    assert whole == sizes
    pieces = sorted((r["start"], r["n_tokens"]) for r in out if r["doc_id"] == 1000)
    assert pieces == [(0, 300), (300, 300), (600, 300), (900, 50)]
    assert sum(1 for r in out if r["doc_id"] == 1001) == 1
    assert sum(used.values()) / (len(used) * 300) > 0.92  # about three items a container
    assert packing.pack(df.limit(0), 300).count() == 0
    with pytest.raises(ValueError, match="capacity"):
        packing.pack(df, 0)


def test_cost_is_balanced():
    sizes = sorted([100] * 4 + [50] * 8 + [10] * 40, reverse=True)
    where = packing.pack_shard(sizes, 300, 1.0, 0.01)
    cost = {}
    for s, c in zip(sizes, where, strict=True):
        cost[c] = cost.get(c, 0) + s + 0.01 * s * s
    assert len(cost) == 4 and max(cost.values()) < 1.2 * min(cost.values())


def test_fill_of_the_documents(spark):
    used = packing.p9_pack(spark, "/root/testdata/sf0.01", 2048).groupBy("container_id").agg(F.sum("n_tokens").alias("n"))
    r = used.agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.max("n").alias("m")).first()
    assert r["m"] <= 2048 and r["n"] / (r["k"] * 2048) > 0.97


OWN = [
    ("[quote=a]keni wrote:\n>one\n>two [...][/quote]\nMine here.\n-- \nsig", [["mine", "here"]]),
    ("[quote][quote=z]c[/quote]\nx y\n[/qoute]\nown", [["own"]]),
    ("<blockquote>[quote=t]x said:\n>a [...]</blockquote>\nown text", [["own", "text"]]),
    ("[quote]never closed\n\nown paragraph", [["own", "paragraph"]]),
    ("> quoted\n| quoted\nown &amp; [b]bold[/b]. Next", [["own", "bold"], ["next"]]),
    ("Visit http://x.example now\nown", [["own"]]), ("prÃ¼fen", [["prüfen"]]), ("", []), (None, []), ("   \n ", []), ("[hr]sig\nx", []),
]


@pytest.mark.parametrize(("text", "want"), OWN)
def test_own_text(text, want):
    assert subjects.own_sentences(text) == want


def test_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = table(spark, d, "documents"), table(spark, d, "doc_subject_labels")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    got = {}
    for r in subjects.subjects_of(docs, labels.filter(~held)).collect():
        got.setdefault(r["doc_id"], set()).add(r["subject"])
    test = labels.filter(held).collect()
    hit = sum(r["subject"] in got.get(r["doc_id"], set()) for r in test)
    assert hit / len(test) > 0.9
    assert sum(map(len, got.values())) / len(got) < 1.2


def test_subjects_of_little_or_nothing(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, "word " * 3, "a"), (3, "word " * 3, "a"), (None, "x y z", "a")], "doc_id long, text string, term string")
    labels = spark.createDataFrame([(3, "law", "x"), (3, "law", "x"), (None, "law", "x"), (3, None, "x")], "doc_id long, subject string, annotator string")
    assert subjects.subjects_of(docs, labels).filter("doc_id < 3").count() == 0
    assert subjects.subjects_of(docs.limit(0), labels.limit(0)).count() == 0


def _mentions(words, sentence=None):
    names = ["cooking", "music", "sport"]
    w = {"relay": {"sport": 0.9}, "team": {"sport": 0.8}, "snare": {"music": 1.0}, "reed": {"music": 0.9}, "scale": {"cooking": 0.4, "music": 0.4}}
    table_ = np.array([[x.get(n, 0.0) for n in names] for x in w.values()])
    term = np.array([list(w).index(x) if x in w else -1 for x in words], np.int64)
    of = np.zeros(len(words), np.int64) if sentence is None else np.array(sentence)
    got = subjects._strongest(subjects.mentions(of, term, table_, int(of.max(initial=0)) + 1), 1.3)
    return [names[g] if g >= 0 else None for g in got]


def test_one_mention_is_not_enough():
    assert _mentions(["a", "relay", "team", "but"]) == [None]
    assert _mentions(["relay", "x", "team"]) == ["sport"] and _mentions(["snare", "of", "scale"]) == ["music"] and _mentions([]) == [None]
    assert _mentions(["relay", "team", "snare", "x", "reed"], [0, 1, 2, 2, 2]) == [None, None, "music"]  # neighbours in different sentences
    assert subjects._strongest(np.array([[2.0, 2.0]]), 1.3).tolist() == [0]


def test_leaves_divide_and_name(spark, monkeypatch):
    """A mixed leaf is divided by its labelled documents, one of small talk gets no name; the same with joins in place of sent tables."""
    say = {"law": "court judge verdict appeal", "music": "snare reed chord tempo", "sport": "relay team goal match", "food": "dough oven simmer broth", "garden": "hedge weed compost bulb", "talk": "thanks bump hello bye"}
    kinds, rows, labels = list(say), [], []
    for i in range(180):
        kind, turn = kinds[i % 6], i // 6
        words = say[kind].split()
        rows.append((i, " x ".join(words[turn % 2 :]) + ".", "a"))
        if kind != "talk" and turn % 3 == 0:
            labels.append((i, kind, "ann"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, term string")
    labels = spark.createDataFrame(labels, "doc_id long, subject string, annotator string")
    want = {(i, kinds[i % 6]) for i in range(180) if i % 6 < 5}
    for most in (300_000, 0):
        monkeypatch.setattr(subjects, "MOST_SENT", most)
        got = {tuple(r) for r in subjects.subjects_of(docs, labels, k=4).collect()}
        assert got == want
    none = labels.limit(0)
    assert subjects.subjects_of(docs, none).count() == 0  # nothing names a leaf
    leaf = spark.createDataFrame([(i, [subjects.term_of(w) for w in say[("law", "music")[i % 2]].split()], 0) for i in range(8)], "doc_id long, words array<long>, leaf int")
    sure = spark.createDataFrame([(0, "law"), (1, "music")], "doc_id long, subject string")
    assert {(r["doc_id"], r["leaf"]) for r in subjects.divided(leaf, sure).collect()} == {(i, f"0:{('law', 'music')[i % 2]}") for i in range(8)}


def test_a_rule_in_the_middle_is_no_signature():
    long = "\n".join(f"line {i}." for i in range(12))
    said = subjects.own_sentences(f"first words\n---\n{long}\n---\nsig")
    assert said[0] == ["first", "words"] and ["line"] in said and ["sig"] not in said
