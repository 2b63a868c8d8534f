"""Mentions of one person, scripts, and the collision check over real entities."""

import re

import pytest

from lattica.llm import pii

KEY = b"k"


def new_of(text):
    new, done = pii.replace(text, KEY, {})
    return new, [s for *_, s in done]


def test_mentions_without_title_share_the_surrogate():
    new, names = new_of("Mr Peter Smith left. Peter Smith came back. Smith called, and Peter left.")
    given, family = names[0].split(" ")
    assert names == [names[0], names[0], family, given] and given in pii.GIVEN["m", "latin"]
    assert "Smith" not in new and "Peter" not in new
    assert new_of("Mr Smith and Mr Peter Smith")[1] == [family, names[0]]


@pytest.mark.parametrize(
    "text,gone,gender",
    [("Mr John Ronald Tolkien wrote. Tolkien slept.", ["John", "Ronald", "Tolkien"], "m"), ("Dr Anna Jones spoke", ["Anna", "Jones"], "f"), ("Anna Jones spoke to Dr. J. R. Baker", ["Anna", "Jones", "Baker"], "f"), ("Prof Xyla Brown wrote", ["Xyla", "Brown"], ""), ("Frau Ursula von der Heide", ["Ursula", "Heide"], "f")],
)
def test_whole_names_go(text, gone, gender):
    new, names = new_of(text)
    assert not any(re.search(rf"\b{w}\b", new) for w in gone) and names[0].split(" ")[0] in pii.GIVEN[gender, "latin"]


@pytest.mark.parametrize("text,script", [("Κύριος Νίκος Παπαδόπουλος ήρθε. Παπαδόπουλος!", "GREEK"), ("Госпожа Анна Иванова и Иванова", "CYRILLIC"), ("Mr 山田太郎 and 山田太郎", "CJK"), ("Mr שמעון כהן", "HEBREW")])
def test_scripts_are_kept(text, script):
    import unicodedata

    new, names = new_of(text)
    assert names and all(unicodedata.name(c).startswith(script) for n in names for c in n if c.isalpha())
    assert all(e.value not in new for e in pii.detect(text))


def test_capitals_and_hyphens_are_kept():
    _, names = new_of("Mr SMITH met Mrs Jones-Miller")
    assert names[0].isupper() and [p.istitle() for p in names[1].split("-")] == [True, True]


def test_forms_of_a_number_are_one():
    _, (one, two) = new_of("+1 743 555 3824 and (743) 555-3824")
    assert re.sub(r"\D", "", one) == "1" + re.sub(r"\D", "", two)


def test_account_numbers_stay_valid():
    ok = lambda s: int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1
    assert ok("DE89370400440532013000") and ok(pii.surrogate(KEY, "iban", "DE89370400440532013000")) and not ok(pii.surrogate(KEY, "iban", "DE88370400440532013000"))


def check(again, entities, syllables):
    new = {(k, x): pii.surrogate(KEY, k, x, again.get((k, x), 0), syllables) for k, x in entities}
    own = lambda k, x: x.split(":")[1] if k in ("name", "given") else x
    for kind in {k for k, _ in entities}:
        scoped = [(x.split(":", 2)[2] if kind == "given" else "", s) for (k, x), s in new.items() if k == kind]
        assert len(set(scoped)) == len(scoped)
        if kind != "given":
            assert not {s for _, s in scoped} & {own(k, x) for k, x in entities if k == kind}
    assert all(s != own(k, x) for (k, x), s in new.items())


def test_no_surrogate_is_another_real_entity(spark):
    """Brute force over all pairs, with names and numbers that the first draws give to others."""
    names = [("name", f":Name{chr(97 + k % 26)}{chr(97 + k // 26)}") for k in range(40)]
    names += [("name", ":" + pii.surrogate(KEY, *n, 0, 2)) for n in names[:20]]
    numbers = [("ssn", f"1234567{k:02d}") for k in range(50)]
    numbers += [("ssn", pii.surrogate(KEY, *n)) for n in numbers[:20]]
    given = [("given", f"m:Given{chr(97 + k)}:Smith") for k in range(26)] + [("given", "m:Paul:Smith"), ("given", "f:Anna:Jones")]
    entities = sorted({*names, *numbers, *given})
    again, used = pii._collisions(spark.createDataFrame(entities, "kind string, entity string"), KEY, 2)
    assert again
    check(again, entities, used)


def test_a_used_up_format_grows(spark):
    entities = [("secret", f"_____{k}") for k in range(10)]
    again, used = pii._collisions(spark.createDataFrame(entities, "kind string, entity string"), KEY)
    new = [pii.surrogate(KEY, *e, again.get(e, 0), used) for e in entities]
    assert len(set(new)) == 10 and not any(a == b[1] for a, b in zip(new, entities))


def test_both_ways_of_drawing_again_agree(spark, monkeypatch):
    rows = [(k, f"Mr Name{chr(97 + k % 26)}{chr(97 + k // 26)} and Mrs Vera Name{chr(97 + k % 7)}a met at 10.0.0.{k}. " + "text " * (30_000 if k == 3 else 3), "x") for k in range(60)] + [(7, None, "x"), (8, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, entities string").repartition(4)
    read = lambda: sorted((r[0], r[1] or "", str(r[3])) for r in pii.pseudonymise(docs, KEY, syllables=2).collect())
    one = read()
    monkeypatch.setattr(pii, "MOST_DRAWN_AGAIN", 0)
    assert read() == one
    assert pii.pseudonymise(docs, KEY).columns == ["doc_id", "text", "entities", "entities"]
