from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest

from kerbstone.llm import encodings as e
from kerbstone.llm.encodings import CHAINS, find_garbled, garble, inspect, pieces, restore, train


@pytest.fixture(scope="module")
def texts(small):
    import pyarrow.parquet as pq

    return [t for t in pq.read_table(f"{small}/documents.parquet").column("text").to_pylist() if t]


@pytest.fixture(scope="module")
def model(texts):
    word = e.cutter()[0]
    return train(Counter(w for t in texts for w in word.findall(t)))


def test_round_trip_of_every_chain(texts):
    word = e.cutter()[0]
    sample = sorted({w for t in texts for w in word.findall(t)})[::5]
    for chain in CHAINS:
        done = 0
        for w in sample:
            try:
                g = garble(w, chain)
            except UnicodeError:
                continue
            if g != w:
                try:
                    assert restore(g, chain) == w
                    done += 1
                except UnicodeError:
                    pass
        assert done > 20, chain


def test_held_out_accuracy(texts):
    """Trained on one half of the documents. Sentences of the other half, garbled, are found, and restored where the chain allows; as they are,
    they are left alone."""
    word = e.cutter()[0]
    distinct = sorted(set(texts), key=lambda t: hashlib.md5(t.encode()).digest())
    half = train(Counter(w for t in distinct[::2] for w in word.findall(t)))
    # what the classifier of all documents finds garbled as it is can't be told from a wrong finding, so it takes no part
    known = train(Counter(w for t in distinct for w in word.findall(t)))
    clean = [t for t, g in zip(distinct[1::2], inspect(known, distinct[1::2]), strict=True) if not g.spans]
    lines = [x for t in clean for x in t.split("\n") if sum(c > "\x7f" for c in x) >= 6]
    random.Random(1).shuffle(lines)
    hits = restored = tries = lost = lost_hits = 0
    for chain in (*((("utf-8", b),) for b in ("cp1252", "latin-1", "cp1251", "cp437")), (("cp1251", "mac-roman"),), (("koi8-r", "cp1251"),), (("cp1251", "latin-1"),), (("utf-8", "cp1252"), ("utf-8", "cp1252")), *e.LOSSY):
        made = []
        for x in lines:
            try:
                g = garble(x, chain)
            except UnicodeError:
                continue
            if g != x and len(made) < 60 and (chain not in e.LOSSY or "\ufffd" in g):
                made.append((x, g))
        for (x, g), found in zip(made, inspect(half, [g for _, g in made]), strict=True):
            if chain in e.LOSSY:
                lost += 1
                lost_hits += bool(found.spans)
            else:
                tries += 1
                hits += bool(found.spans)
                restored += found.restored(g) == x
    wrong = sum(bool(g.spans) for g in inspect(half, clean))
    print(f"found {hits} of {tries}, restored {restored}; lossy {lost_hits} of {lost}; wrong {wrong} of {len(clean)}")
    assert tries > 200 and lost > 60
    assert hits / tries > 0.97 and lost_hits / lost > 0.97
    assert restored / tries > 0.85
    assert wrong <= 0.02 * len(clean)


def test_right_text_is_left_alone(model):
    right = ["MAÇÃ, PÃO e LIMÃO aparecem no letreiro.", "«CAFÉ» à côté — déjà vu", "6 °C ±32 ms, 5 m²", "ХЛЕБ, САХАР и ТЕАТР", "相机比轨迹晚了1.3毫秒。", "🚲 👍🏽 → ≥", "plain ascii", "naïve Straße Öffnungszeiten"]
    assert [g.spans for g in inspect(model, right)] == [[]] * len(right)


def test_cases(model):
    got = inspect(model, ["La camÃ©ra Ã©tait lÃ\u00a0.", "Stra��e", None, "", "\n".join(["ok"] * 3 + ["gegenÃ¼ber"])])
    assert [len(g.spans) for g in got] == [3, 1, 0, 0, 1]
    assert got[0].restored("La camÃ©ra Ã©tait lÃ\u00a0.") == "La caméra était là."
    assert got[1].spans[0][2].text is None
    assert train(Counter()).scores(["é"]).shape == (1, len(CHAINS) + len(e.LOSSY) + 1)


def test_long_texts_are_looked_at_whole(model, monkeypatch):
    monkeypatch.setattr(e, "PIECE_CHARS", 1000)
    text = ("word " * 300 + "\n") * 40 + "Ã©tÃ© " + "x" * 5000 + " gegenÃ¼ber"
    assert "".join(p for _, p in pieces(text)) == text
    assert all(text.startswith(p, at) for at, p in pieces(text))
    (g,) = inspect(model, [text])
    assert [text[lo:hi] for lo, hi, _ in g.spans] == ["Ã©tÃ©", "gegenÃ¼ber"]


def test_table(spark, texts):
    rows = [(i, t, "x") for i, t in enumerate(texts[:300])] + [(900, "La camÃ©ra Ã©tait lÃ\u00a0", "y"), (900, "La camÃ©ra Ã©tait lÃ\u00a0", "y"), (901, None, None), (902, "", None), (None, "camÃ©ra", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, restored string")
    got = {r["doc_id"]: r for r in find_garbled(df).collect()}
    assert got[900]["restored"] == "La caméra était là" and got[900]["words"] == 3 and got[900]["lost"] == 0
    assert None in got and 901 not in got and 902 not in got
    assert find_garbled(df.limit(0)).count() == 0


def test_words_vote_by_all_documents_not_by_the_sample(spark, texts, monkeypatch):
    """A short passage whose words the training sample lacks, but twenty documents of the corpus have."""
    word = e.cutter()[0]
    sample = Counter(w for t in texts for w in word.findall(t))
    monkeypatch.setattr(e, "training_words", lambda *_: sample)
    model, passage = train(sample), garble("гвоздь", (("koi8-r", "cp1251"),))
    assert not model.seen["гвоздь"] and not inspect(model, [passage])[0].spans
    rows = [(i, f"гвоздь {i}") for i in range(20)] + [(20, passage), (21, passage), (21, passage)]
    got = find_garbled(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["restored"]) for r in got) == [(20, "гвоздь"), (21, "гвоздь"), (21, "гвоздь")]


def test_words_of_a_passage_are_pooled_over_ascii_words(model):
    """Latin script: one or two characters beyond ASCII a word, and plain words between them."""
    text = "Die Straße ist für Fußgänger gesperrt, das Café gegenüber hat geöffnet und schließt später, die Brücke führt über Gleise"
    for chain in ((("cp1252", "cp1251"),), (("cp1252", "mac-roman"),), (("cp1252", "cp437"),), (("cp437", "cp1252"),)):
        (g,) = inspect(model, [garble(text, chain)])
        assert {v.chain for _, _, v in g.spans} == {chain}
        assert g.restored(garble(text, chain)) == text
    mixed = garble(text, (("cp1252", "cp1251"),)) + "\n" + garble(text, (("cp1252", "cp437"),))
    assert inspect(model, [mixed])[0].restored(mixed) == f"{text}\n{text}"
    assert not inspect(model, [text])[0].spans
