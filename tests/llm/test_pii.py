"""Disguises in four languages and their offsets, and clean texts that look a little like them."""

import time

import pytest

from fringeflow.llm import pii


@pytest.mark.parametrize("before, span, after, kind", [
    ("ip ", "10 dot 20 dot 30 dot 40", " up", "ip"), ("call ", "plus one one one one one one one one", ".", "phone"),
    ("write ", "joe at mail dot ru", " soon", "email"), ("escribe a ", "joe arroba example punto com", ", gracias", "email"),
    ("mél : ", "jean point dupont arobase exemple point fr", " merci", "email"), ("an ", "max klammeraffe firma punkt de", " senden", "email"),
    ("llama al ", "más tres cuatro cinco seis siete ocho nueve cero", " hoy", "phone"), ("ruf ", "plus vier neun drei null eins zwei drei vier fünf sechs", " an", "phone"),
    ("carte ", "quatre un un un un un un un un un un un un un un un", " !", "card"), ("host ", "192[.]168[.]0[.]1", " down", "ip"),
    ("tel ", "+1 555 seven 34 5678", "", "phone"), ("x ", "𝐣𝐨𝐞@example.com", " y", "email"), ("x ", "joe＠example．com", " y", "email"), ("n ", "٤١١١١١١١١١١١١١١١", " y", "card"),
    ("x ", "jo​e@exam​ple.com", " y", "email"), ("mail ", "joe   {at}\n example (dot) co (dot) uk", "\n", "email"), ("mail ", "joe @ example . org", " ok", "email"), ("mail ", "a at b dot c dot d dot info", " ok", "email"),
])
def test_disguises_have_their_offsets(before, span, after, kind):
    base, more = pii.find(before + span + after)
    assert more[kind] == [(len(before), len(before) + len(span))], (base, more)
    assert pii.redacted(before + span + after) == f"{before}<{kind.upper()}>{after}"


@pytest.mark.parametrize("text", [
    "she looked at the dot in the middle", "we arrived at noon.then we left", "look at me . it was late", "at one point in time", "un point de vue, deux points", "one dot two", "he lives at 10 point 5 miles",
    "почта@пример.рф", "кот@example", "version 1 dot 2 dot 3", "a plus b", "eins zwei drei", "the dot at the end. In it", "½ cup at 5 dot", "two at a time . so be it",
])
def test_clean_texts(text):
    base, more = pii.find(text)
    assert not any(more.values()) and not any(base.values()), more


def test_long_texts_take_linear_time():
    for unit in (" ", "at ", "one ", "a@", "dot ", "( ", "+ ", "a dot ", "joe at x dot ", "1 dot "):
        began = time.process_time()
        pii.find(unit * 60_000)
        assert time.process_time() - began < 5, unit
