from __future__ import annotations

import unicodedata

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from kerbstone.llm import lookalikes as k
from kerbstone.llm.lookalikes import consistent_form, misread_signs, with_form

ALIKE = {ord(o): latin for latin, others in k.DRAWN_ALIKE.items() for o in others}


def form(*texts):
    return consistent_form(pa.array(texts, pa.string())).to_pylist()


def slow(text):
    """The same form, one text at a time, by string calls."""
    out = ""
    for c in text:
        code = ord(c)
        if unicodedata.category(c) == "Cf" or code in k._INVISIBLE or 0xFE00 <= code <= 0xFE0F or 0xE0100 <= code <= 0xE01EF:
            continue
        if c.isspace() or unicodedata.category(c) == "Zs":
            out += " "
        elif 0xAC00 <= code < 0xD7A4:
            out += c
        else:
            out += "".join(map(k._decomposed, k.LIGATURES.get(c, c))).translate(ALIKE)
    return unicodedata.normalize("NFC", " ".join(x for x in out.split(" ") if x))


def test_same_look():
    same = ["Café  du Port", "Café du Port", "​Ｃａｆé du　Port ", "Саfé du Ро­rt⁠", "﻿Café du P‍ort"]
    assert set(form(*same)) == {"Café du Port"}
    assert form("oﬃce", "ŒUVRE", "OEUVRE", "ﬁn") == ["office", "OEUVRE", "OEUVRE", "fin"]
    assert form("ЇДАЛЬНЯ", "ЇДAЛЬНЯ")[0] == form("ЇДАЛЬНЯ", "ЇДAЛЬНЯ")[1]


def test_other_look():
    forms = form("Cafe", "Café", "CAFÉ", "Caf é", "C4fé", "st0ax", "stoax", "ИОГУРТ", "ЙОГУРТ", "АПТЕКАЛЕ", "АПТЕКА ЛЕ")
    assert len(set(forms)) == len(forms)


def test_edges():
    assert form() == []
    assert form(None, "", " ​ ", "a", None) == [None, "", "", "a", None]
    assert form("x́" * 50_000)[0] == unicodedata.normalize("NFC", "x́" * 50_000)
    sliced = pa.array(["zz", None, "é b", "ｂ"]).slice(1, 3)
    assert consistent_form(sliced).to_pylist() == [None, "é b", "b"]


@given(st.lists(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("aeọ̧́̂̈ ​Аеﬁ가ㄱ각")), max_size=25), max_size=8))
@settings(max_examples=300, deadline=None)
def test_equals_the_slow_way(texts):
    got = form(*texts)
    want = [slow(t) for t in texts]
    # an alternative of a composed pair that two scripts share is represented by one of them
    assert [unicodedata.normalize("NFD", g).translate(ALIKE) for g in got] == [unicodedata.normalize("NFD", w).translate(ALIKE) for w in want]
    assert form(*got) == got


def rows(spark):
    schema = "ann_id long, sequence string, detections array<struct<box: array<double>, text: string>>, sign_id string, form int"
    return spark.createDataFrame(
        [(1, "s", [(None, "Cafе"), (None, "Cafe"), (None, None), (None, "")], "x", 1), (1, "s", [(None, "Cafе"), (None, "Cafe"), (None, None), (None, "")], "x", 1), (2, None, None, None, None), (3, "s", [], None, None), (None, "s", [(None, "Cаfe")], None, None), (4, "s", [(None, "​"), (None, " Cafe" + " " * 100_000)], None, None)],
        schema,
    )


def test_misread_signs(spark):
    lexicon = spark.createDataFrame([(7, "Cafe"), (8, "Cаfe"), (9, None), (10, ""), (None, "Cafe")], "sign_id long, text string")
    got = sorted(tuple(r) for r in misread_signs(rows(spark), lexicon).collect())
    assert got == [(1, 0, 7), (1, 0, 8), (1, 1, 8), (4, 1, 7), (4, 1, 8)]
    assert misread_signs(rows(spark).limit(0), lexicon).count() == misread_signs(rows(spark), lexicon.limit(0)).count() == 0


def test_with_form_keeps_columns(spark):
    df = spark.createDataFrame([(1, "ａ", "old")], "id int, `a b` string, form string")
    assert with_form(df, "a b").collect()[0].asDict() == {"id": 1, "a b": "ａ", "form": "a"}
