import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cuelight.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, c in enumerate(digits[::-1]):
        n = int(c) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def plainly(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


@settings(max_examples=1500, deadline=None)
@given(st.text("a.@-+1 90(5é", max_size=60))
def test_base_spans(text):
    assert pii.base_spans(text) == plainly(text)


def test_base_spans_of_likely_texts():
    rng = random.Random(4)
    parts = ["4524132264652876", "4524 1322 6465 2876", "+1 (269) 555-3296", "a.b@c-d.example.com", "10.0.0.1", "256.1.1.1", "1.2.3.4.5", "x@y", "and", ",", "+", "12"]
    for _ in range(1500):
        text = "".join(rng.choice(parts) + rng.choice([" ", "", "."]) for _ in range(rng.randint(1, 9)))
        assert pii.base_spans(text) == plainly(text)


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "+1" + " " * 200_000, "1." * 100_000, "a@" * 100_000):
        pii.spans(text)


def test_the_field_adds_distant_mentions():
    text = "Mail anna.42@mail.example.com, later anna.42(at)mail.example.com or 4524132264652876 then 4524.1322.6465.2876; 1234567890123456 isn't."
    base, every = pii.spans(text)
    assert base == plainly(text) and every[: len(base)] == base
    assert {text[a:b] for _, a, b in every[len(base) :]} == {"anna.42(at)mail.example.com", "4524.1322.6465.2876"}
    assert pii.redacted(text) == "Mail <EMAIL>, later <EMAIL> or <CARD> then <CARD>; 1234567890123456 isn't."


@pytest.mark.parametrize("text", [None, "", "no data here", "only 1234567890123456 twice 1234567890123456"])
def test_nothing_is_added_without_a_base_span(text):
    assert pii.spans(text) == ([], [])
    assert pii.redacted(text) == text


def test_messages_equal_enumeration_on_a_tree():
    import itertools

    import numpy as np

    rng = np.random.default_rng(0)
    unary = rng.normal(size=(4, 3))
    edges = np.array([(0, 1), (1, 2), (1, 3)])
    tables = rng.normal(size=(3, 3, 3))
    exact = np.zeros((4, 3))
    for labels in itertools.product(range(3), repeat=4):
        p = np.exp(sum(unary[i, x] for i, x in enumerate(labels)) + sum(tables[k, labels[a], labels[b]] for k, (a, b) in enumerate(edges)))
        for i, x in enumerate(labels):
            exact[i, x] += p
    exact /= exact.sum(axis=1, keepdims=True)
    assert np.allclose(pii._messages(unary, edges, tables, rounds=60), exact, atol=1e-3)


def test_held_out_generated_sentences():
    import numpy as np

    rng, right, all_ = np.random.default_rng(99), 0, 0
    for _ in range(40):
        tokens, bases, truth = pii._generated(rng)
        text = ", ".join(tokens)  # so that neighbouring numbers don't run into one
        found = {(a, b): k for k, a, b in pii.spans(text)[1]}
        at = 0
        for t, base, label in zip(tokens, bases, truth):
            if base is None and label and any(pii._fold(t) == pii._fold(u) for u, b in zip(tokens, bases) if b):
                all_ += 1
                right += (at, at + len(t)) in found
            at += len(t) + 2
    assert all_ > 20 and right / all_ > 0.7


def scores(find):
    """(precision, recall) of what is added to base spans in generated sentences that training hasn't seen."""
    import numpy as np

    rng, right, said, wanted = np.random.default_rng(77), 0, 0, 0
    for _ in range(80):
        tokens, bases, truth = pii._generated(rng)
        at, places = 0, []
        for t in tokens:
            places.append((at, at + len(t)))
            at += len(t) + 2
        want = {(pii.LABELS[y], *p) for y, b, p in zip(truth, bases, places) if b is None and y}
        got = find(tokens, bases, places)
        right, said, wanted = right + len(want & got), said + len(got), wanted + len(want)
    return right / max(said, 1), right / wanted


def test_the_field_against_a_lookup_and_against_a_chain():
    """Skips carry what is known to mentions that are only similar; a lookup of equal ones and a chain miss them."""
    import numpy as np

    def lookup(tokens, bases, places):
        known = {(pii._fold(t), b) for t, b in zip(tokens, bases) if b}
        return {(k, *p) for t, b, p in zip(tokens, bases, places) if b is None for k in pii.KINDS if (pii._fold(t), k) in known}

    def by(field):
        def find(tokens, bases, places):
            base, every = pii.spans(", ".join(tokens), field=field)
            return set(every[len(base) :])

        return find

    whole = pii.trained()
    chain = pii.Field(whole.unary, whole.chain, np.zeros(3))
    skips, equal, none = scores(by(whole)), scores(lookup), scores(by(chain))
    assert skips[0] > 0.97 and skips[1] > 0.95
    assert equal[1] < skips[1] - 0.2 and none[1] < equal[1] - 0.2


def test_shipped_weights_are_the_fitted_ones():
    import numpy as np

    field, shipped = pii.fitted(), pii.trained()
    assert np.allclose(field.unary, shipped.unary, atol=0.01) and np.allclose(field.chain, shipped.chain, atol=0.01)
    assert np.allclose(field.skip, shipped.skip, atol=0.01)


def test_a_mention_with_one_wrong_digit():
    text = "pay 4524132264652876, I mean 4524132264652875, not 4524132264652111 or 9999132264652875"
    base, every = pii.spans(text)
    assert [text[a:b] for _, a, b in every[len(base) :]] == ["4524132264652875"]


def test_digest(spark):
    df = spark.createDataFrame([(1, "x a@b.cc"), (2, None), (None, "")], "doc_id long, text string")
    rows = df.select("doc_id", pii.span_digest("text").alias("f")).select("doc_id", "f.*").collect()
    assert [(r["n_email"], r["spans"]) for r in rows] == [(1, "email:2:8"), (0, ""), (0, "")]
    assert df.limit(0).select(pii.span_digest("text").alias("f")).count() == 0


def test_mentions_of_many_tokens():
    """Phones as the tables write them come again without their country, area or punctuation; so do parts of cards."""
    rng, right, all_ = random.Random(12), 0, 0
    word = lambda: "".join(rng.choice("abdeginorst") for _ in range(rng.randint(2, 7)))
    for _ in range(200):
        a, b, c = rng.randint(200, 999), rng.randint(200, 999), rng.randint(1000, 9999)
        forms = [f"1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{b}-{c}", f"{a} {b} {c}", f"001 {a} {b} {c}", f"{a}.{b}.{c}"]
        parts = [word(), f"+1 ({a}) {b}-{c}"]
        wanted = rng.sample(forms, 3)
        for form in wanted:
            parts += [word() for _ in range(rng.randint(1, 30))] + [form]
        parts += [word(), f"{b}-{(c + 7) % 10000:04d}", word(), f"{rng.randint(10, 99)} {rng.randint(100, 999)}", word()]
        text = " ".join(parts)
        base, every = pii.spans(text)
        assert base == plainly(text)
        more = {text[x:y] for _, x, y in every[len(base) :]}
        assert more <= set(wanted)
        all_ += 3
        right += len(more)
    assert right / all_ > 0.95
    for text, wanted in [
        ("card 4524132264652876 then 1322 6465 2876 or 9999 6464 2876", {"1322 6465 2876"}),
        ("mail anna.42@mail.example.com or anna.42 [at] mail.example.com, not bob at mail.example.com", {"anna.42 [at] mail.example.com"}),
        ("call +1 (269) 555-3296 or 12 269 555 3296", {"269 555 3296"}),
    ]:
        base, every = pii.spans(text)
        assert {text[x:y] for _, x, y in every[len(base) :]} == wanted


@pytest.mark.parametrize("base, again", [("4524132264652876", "4524.1322.6465.2876"), ("10.0.0.1", "10-0-0-1")])
def test_distant_mentions_in_a_long_document(base, again):
    found = pii.spans(base + f" word {again}" * 200)
    assert len(found[0]) == 1 and len(found[1]) == 201
