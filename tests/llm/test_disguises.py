"""Disguises of short digit runs, disguises inside disguises, and longer spans over plain ones."""

import random

import pytest

from morphlake.llm import op7_pii_transducers as op7


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("host one nine two dot one six eight dot one dot one zero up", "ip", "one nine two dot one six eight dot one dot one zero"),
        ("host one nine two.one six eight.one.one zero.", "ip", "one nine two.one six eight.one.one zero"),
        ("host 192 dot one six eight dot 1 [dot] ten", None, None),
        ("host 192 dot one six eight dot 1 [dot] nine", "ip", "192 dot one six eight dot 1 [dot] nine"),
        ("joe [\u0430t] example [d\u043et] com", "email", "joe [\u0430t] example [d\u043et] com"),
        ("joe (\uff20) example.com", "email", "joe (\uff20) example.com"),
        ("ring plus \u043ene two three f\u200bour five six seven eight nine", "phone", "plus \u043ene two three f\u200bour five six seven eight nine"),
        ("ring +four four 20 seven nine four six zero nine five eight", "phone", "+four four 20 seven nine four six zero nine five eight"),
        ("joe@example.com dot uk", "email", "joe@example.com dot uk"),
    ],
)
def test_disguise_is_found(text, kind, found):
    base, spans = op7.spans(text)
    assert set(base) <= set(spans)
    if kind is None:
        assert spans == base
    else:
        assert (kind, found) in {(k, text[a:b]) for k, a, b in spans}


def test_plain_span_stays_beside_the_longer_one():
    assert op7.spans("joe@example.com dot uk") == ([("email", 0, 15)], [("email", 0, 15), ("email", 0, 22)])


def test_positions_of_random_texts():
    rng = random.Random(4)
    parts = ["one", "two", " ", "-", ".", " dot ", "[dot]", "\u0430t", " at ", "plus ", "+", "12", "@", "x", "\u200b", "\uff20", "(", ")", "9"]
    for _ in range(20_000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        base, spans = op7.spans(t)
        assert set(base) <= set(spans) and all(0 <= a < b <= len(t) for _, a, b in spans), t


def test_long_runs_end():
    for t in ("one " * 4_000, "one dot " * 20_000, "1." * 40_000 + "one", "plus one " * 20_000, "+one " * 20_000, "one - " * 4_000):
        op7.spans(t)


def test_numbers_of_any_length(spark):
    assert op7.plain("0" * 5000 + ".1.1.1") == [("ip", 0, 5006)]
    assert op7.plain("1" * 5000 + ".1.1.1") == []
    docs = spark.createDataFrame([((1 << 60) + 1, "0" * 5000 + ".1.1.1 " + "9" * 200_000 + " a@b.co"), (None, None)], "doc_id long, text string")
    found = {r.doc_id: (r.n_ip, r.n_email) for r in op7.find_personal_data(docs).collect()}
    assert found == {(1 << 60) + 1: (1, 1), None: (0, 0)}
