"""Problems 3 and 6: languages and personal information, by held-out accuracy on small inputs."""

import random
import re

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from wordtide.llm import language_id as LI
from wordtide.llm import pii as PI
from held_out_pii import SENTENCES
from wordtide.llm import pii_examples as PE
from wordtide.llm.pii_examples import KINDS, labelled

SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def model(documents):
    return LI.train(LI.sample(documents, "doc_id", "text", "lang"))


def test_bits_are_probabilities(model):
    """For a known context the chances of all bytes sum to no more than one, escapes included."""
    languages = len(model.languages)
    context = b" la"
    keys = []
    for order in range(LI.ORDER + 1):
        key = np.arange(256, dtype=np.int64)
        for i in range(min(order, len(context))):
            key = key + (int(context[-1 - i]) << 8 * (i + 1))
        keys.append(key if order <= len(context) else np.full(256, -1))
    total = (2.0 ** -model._price(keys, LI.ORDER).astype(float)).sum(0)
    assert total.shape == (languages,) and (total > 0.2).all() and (total <= 1.35).all()


def test_held_out_accuracy(documents):
    """A model of a few texts on the first lines of all others; only closing lines are in other languages."""
    learnt = LI.sample(documents, "doc_id", "text", "lang", 20)
    small = LI.train(learnt)
    seen = {t for own in learnt.values() for t in own}
    rows = documents.where("lang IS NOT NULL AND text <> ''").select("text", "lang").toPandas()
    lines = [(text.split("\n")[0], lang) for text, lang in zip(rows.text, rows.lang, strict=True) if text not in seen and "\n" in text]
    got = LI.classify(small, [t for t, _ in lines])
    assert np.mean([g[0] == lang for g, (_, lang) in zip(got, lines, strict=True) if g]) > 0.97


def test_mixed_and_not(model):
    en, es = "we filmed the quiet river with my cousin before breakfast", "mi mamá dice que la cámara es más tranquila que el puente"
    lang, _, segments = LI.classify(model, [f"{en} — {es}"])[0]
    assert {s[0] for s in segments} == {"en", "es"}
    for text in (f"Golden Lake: {es}", f"{en}, meet at Rua das Flores 12", f"{es} bokimano", f"thanks to Пётр Громов, {en}"):
        assert LI.classify(model, [text])[0][2] == []
    both = LI.classify(model, ["これはとても静かなコーヒーです we filmed the quiet river with my cousin"])[0]
    assert {s[0] for s in both[2]} == {"ja", "en"}


def test_segments_have_places_and_confidence_is_of_the_language(model):
    en, es = "we filmed the quiet river with my cousin before breakfast", "mi mamá dice que la cámara es más tranquila que el puente"
    wide = en.replace("quiet", "\u200bqu\u200biet").replace("river", "ｒｉｖｅｒ")
    for a, b in ((en, es), (es, en), (wide, es), (es.replace("á", "a\u0301"), wide)):
        text = f"@some.one {a} https://x.example/a — {b} #tag"
        lang, sure, segments = LI.classify(model, [text])[0]
        assert len(segments) == 2 and sure > 0.5
        assert [text[s[3] : s[4]] for s in segments] == [a if "\u200b" not in a else a, b]
        longest = max(segments, key=lambda s: s[4] - s[3])
        assert lang in {s[0] for s in segments} and sure in {s[1] for s in segments if s[0] == lang} and longest[4] <= len(text)


def test_marks_count_in_segments(model):
    """A sentence in Devanagari has a third of its letters in vowel signs."""
    for hi in ("यह रोटी बहुत नाज़ुक है इसे मत छोड़ना", "मैंने कभी इतना नाज़ुक गिटार नहीं देखा", "देखो हमने कैसे खाना के साथ तूफ़ान खोला"):
        for text in (f"you don’t need a broken engine to love this notebook | {hi}", f"{hi} — you don’t need a broken engine to love this notebook"):
            assert {s[0] for s in LI.classify(model, [text])[0][2]} == {"en", "hi"}
        for text in (hi, f"Maple Festival: {hi}", f"{hi} on 2024-05-17 bakigatabi", "हिन्दी, you don’t need a broken engine to love this notebook"):
            assert LI.classify(model, [text])[0][2] == []


def test_short_cyrillic_segment(model):
    en = "we filmed the quiet river with my cousin before breakfast"
    for text in (f"{en}. Спасибо за просмотр", f"Спасибо за просмотр! {en}"):
        assert {s[0] for s in LI.classify(model, [text])[0][2]} == {"en", "ru"}
    for text in (f"{en} with Пётр Громов", f"{en}, ул. Большая Садовая, д. 12", f"{en} привет", f"Анна и Пётр Громов, {en}"):
        assert LI.classify(model, [text])[0][2] == []


def test_no_language(model):
    assert LI.classify(model, [None, "", "wow #longhashtaghere @someone", "🔥🔥", "http://a.example/longpathhere"]) == [None] * 5


def test_garbled_and_look_alike(model):
    assert LI.classify(model, ["Ð½Ðµ Ð¿Ñ€Ð¾Ð¿ÑƒÑÑ‚Ð¸Ñ‚Ðµ Ð¿ÐµÑÐ½ÑŽ"])[0][0] == "ru"
    assert LI.classify(model, ["we fіlmеd thе quіеt rіvеr wіth mу соuѕіn"])[0][0] == "en"


def test_label_problems(spark, model):
    text = "we filmed the quiet river with my cousin before breakfast"
    labels = ["en", "EN-us", "en_GB", "es", None, "", "und", "xx"]
    rows = [(i, text, label) for i, label in enumerate(labels)] + [(50, None, "en"), (51, "short", "es"), (52, text * 300, "fr")]
    df = spark.createDataFrame(rows, "row_id long, desc string, lang string").withColumn("segments", F.lit(1))
    got = sorted((r.row_id, r.lang) for r in LI.label_problems(df, model).collect())
    assert got == [(i, "en") for i in (3, 4, 5, 6, 7)] + [(52, "en")]
    assert LI.label_problems(df.where("false"), model).collect() == []
    whole = LI.identify(df, model)
    assert whole.columns == [*df.columns, "language"] and whole.where("row_id = 50").first().language is None


def test_training_needs_little(spark):
    empty = LI.train({language: [] for language in LI.LANGUAGES})
    assert LI.classify(empty, ["some words without any model"])[0][0] in LI.LANGUAGES


@pytest.fixture(scope="module")
def tagger(documents):
    return PI.fit(documents, documents.sparkSession.read.parquet(f"{SMALL}/name_hints.parquet"))


def per_kind(tagger, texts, truth):
    """(kind, recall, precision) on texts whose kinds are known."""
    found = [{k for _, _, k in spans} for spans in tagger.spans(texts)]
    for kind in KINDS:
        hits = sum(kind in a and kind in b for a, b in zip(found, truth, strict=True))
        yield kind, hits / sum(kind in b for b in truth), hits / max(1, sum(kind in a for a in found))


def test_sentences_written_apart(tagger):
    """What the README states: sentences that neither the labelled table nor the driver's tables hold."""
    for kind, recall, precision in per_kind(tagger, [t for t, _ in SENTENCES], [k for _, k in SENTENCES]):
        assert recall >= 0.9 and precision >= 0.9, kind


def test_same_rule_other_seed(tagger, documents):
    """That the chain has learnt its table; not a measure of accuracy, as the rule that writes the texts is the same."""
    held = labelled(PI.plain_text(documents, "doc_id", "text", "lang").lines, 600, seed=11)
    for kind, recall, precision in per_kind(tagger, [t for t, _ in held], [{k for _, _, k in spans} for _, spans in held]):
        assert recall > 0.93 and precision > 0.93, kind


def test_nothing_learnt_stands_in_the_tables():
    """No piece of a clause, decoy or plain line with two words or more is a part of any text that the tagger is run on, nor
    any held-out sentence of the labelled table."""
    pieces = {p.strip(" :,.()").lower() for t in (*(c for own in PE.CLAUSES.values() for c in own), *PE.TAILS, *PE.PLAIN, *PE.DECOYS) for p in re.split(r"\{\w*\}|[9A]+", t)}
    pieces = [p for p in pieces if len(p.split()) > 1 and sum(map(str.isalpha, p)) >= 8]
    assert len(pieces) > 100
    tables = (("videos", "desc"), ("documents", "text"), ("tokenizer_cases", "text"))
    whole = "\n".join({t.lower() for table, c in tables for t in pq.read_table(f"/root/testdata/sf0.1/{table}.parquet", columns=[c])[c].to_pylist() if t})
    assert [p for p in pieces if p in whole] == []
    held = "\n".join(t.lower() for t, _ in SENTENCES)
    assert [p for p in pieces if p in held] == [] and [t for t, _ in SENTENCES if t.lower() in whole] == []
    assert [n for n in PE.FAMILY if n.lower() in whole or n.lower() in held] == []


def test_chain_gradient(tagger):
    """The gradient of the likelihood against differences, on a small chain."""
    small = PI.Tagger({})
    examples = labelled([], 3, seed=2)
    found = [PI.tokens(t) for t, _ in examples]
    listed = [PI.described(f, t) for f, (t, _) in zip(found, examples, strict=True)]
    gold = [PI._gold(f, s) for f, (_, s) in zip(found, examples, strict=True)]
    table, flat, starts, lengths = small._ids(listed, True)
    rng = np.random.default_rng(0)
    small.weights = rng.normal(0, 0.1, (len(small.index), 2 * PI.REACH + 1, len(PI.LABELS))).astype(np.float32)
    small.weights[0] = 0
    small.between = rng.normal(0, 0.1, small.between.shape).astype(np.float32)

    def loss() -> float:
        total = 0.0
        e_all = small._emissions(table, flat).astype(float)
        for s, n, labels in zip(starts, lengths, gold, strict=True):
            e, b = e_all[s : s + n], small.between.astype(float)
            a = e[0]
            for t in range(1, n):
                a = np.log(np.exp(a[:, None] + b).sum(0)) + e[t]
            path = e[np.arange(n), labels].sum() + b[labels[:-1], labels[1:]].sum()
            total += np.log(np.exp(a).sum()) - path
        return total

    own, some, pairs = small._gradient(table, flat, starts, lengths, gold)
    whole = np.zeros_like(small.weights)
    whole[own] = some
    assert (own[1:] > 1).any() and np.abs(whole).sum() > 0
    places = [(int(own[i]), PI.REACH + o, label) for i, o, label in ((2, 0, 1), (5, 1, 0), (9, -2, 0), (7, 3, 2))]
    for param, grad, at in (*((small.weights, whole, at) for at in places), (small.between, pairs, (0, 1)), (small.between, pairs, (2, 2))):
        kept, step = param[at], 1e-2
        param[at] = kept + step
        up = loss()
        param[at] = kept - step
        down = loss()
        param[at] = kept
        assert abs((up - down) / (2 * step) - grad[at]) < 2e-2 * max(1, abs(grad[at]))


def test_find(spark, tagger):
    rows = [(1, "contact: ann.lee@mail.example, call me on +44 7700 900 123"), (2, None), (3, ""), (4, "plain words"), (5, "order 4471-88-2031 by @someone"), (6, "x " * 20_000), (7, "contact: ann.lee@mail.example, call me on +44 7700 900 123")]
    df = spark.createDataFrame(rows, "row_id long, desc string").withColumn("kinds", F.lit("own"))
    got = {r.row_id: r for r in PI.find(df, tagger, "desc").collect()}
    assert got[1].pii.redacted == got[7].pii.redacted == "contact: [EMAIL], call me on [PHONE]" and got[1].pii.kinds == ["email", "phone"] and got[1].kinds == "own"
    assert got[2].pii is None and got[3].pii.redacted == "" and got[4].pii.redacted == "plain words" and got[5].pii.kinds == [] and got[6].pii.redacted == rows[5][1]
    assert PI.find(df.where("false"), tagger, "desc").collect() == []
    assert sorted((r.row_id, r.kind) for r in PI.kinds(df, tagger, "row_id", "desc").collect()) == [(1, "email"), (1, "phone"), (7, "email"), (7, "phone")]


def test_offsets_are_those_of_the_text():
    text = "te\u200bl ００44\u00a07700 é\u0301 @a"
    assert [text[a:b].replace("\u200b", "") for a, b, _ in PI.tokens(text)] == ["tel", "００44", "7700", "é\u0301", "@a"]
    assert [t for _, _, t in PI.tokens("www.a.b/c www.me@x.example https://q.r/@s")] == ["www.a.b/c", "www", ".", "me", "@", "x", ".", "example", "https://q.r/@s"]


def test_labelled_table_is_reproducible():
    assert labelled(["a line"], 50) == labelled(["a line"], 50)
    text, spans = random.Random(0).choice([x for x in labelled(["a line"], 200) if x[1]])
    assert all(0 <= a < b <= len(text) for a, b, _ in spans)
