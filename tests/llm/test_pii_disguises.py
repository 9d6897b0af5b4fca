"""Disguised identifiers whose places are known because they were put there, and clean texts that must stay."""

import random

import pytest

from tidewright.llm import pii

DISGUISED = [
    ("email", "alice@example[.]com"),
    ("email", "alice(@)example(.)com"),
    ("ip", "192[.]168[.]0[.]1"),
    ("ip", "10 [dot] 0 [dot] 0 [dot] 255"),
    ("email", "alice -at- example -dot- com"),
    ("email", "alice_at_example_dot_com"),
    ("email", "alice-at-example-dot-com"),
    ("email", "alice @ example . com"),
    ("email", "alice @ mail.example . org"),
    ("email", "alice&#x40;example.com"),
    ("email", "alice&#064;example&#46;com"),
    ("email", "alice&commat;example&period;com"),
    ("email", "&#97;lice@ex&#x61;mple.com"),
    ("email", "\U0001d41a\U0001d425\U0001d422\U0001d41c\U0001d41e@example.com"),
    ("email", "ⓐlice@example.com"),
    ("email", "аlice [at] exаmple [dot] com"),
    ("email", "alice at example dot com"),
    ("email", "alice.b at example.com"),
    ("email", "ALICE AT EXAMPLE.COM"),
    ("card", "41ll l111 1111 1111"),
    ("card", "4l11-1111-1111-111I"),
    ("card", "4111.1111.1111.1111"),
    ("card", "four one one one 1111 1111 1111"),
    ("phone", "plus four nine 170 five five five 1234"),
]
CLEAN = [
    "I was looking at node.js and meet me at example.com",
    "He works at example.com. Write to us soon",
    "look at the dot com bubble",
    "we stay-at-home and the state_at_start holds",
    "it ended (.) and began [.] again",
    "version 4111.1111.1111.1112 of the schema",
    "illo OOoo lIlI 1111 and ll11 l1l1",
    "sold @ . and more @ 5 . then",
    "bought at shop.example in May",
    "they met at 10.30 at noon",
    "AT&amp;T &#38; others &#8212; and &#99999999; too",
    "the dot at the end",
]


@pytest.mark.parametrize(("kind", "part"), DISGUISED)
def test_known_places(kind, part):
    for before, after in (("", ""), ("Here: ", " and more."), ("x, ", ", y")):
        text = before + part + after
        base, every = pii.find(text)
        assert base == pii.plain_spans(text)
        assert (kind, len(before), len(before) + len(part)) in every
        assert pii.masked(text) == f"{before}<{kind}>{after}"


@pytest.mark.parametrize("text", CLEAN)
def test_clean_texts_stay(text):
    assert pii.find(text) == ([], []) and pii.masked(text) == text


@pytest.mark.parametrize("cue", ["write to", "E-mail:", "you can reach", "contact", "schreiben Sie an"])
def test_a_cue_speaks_for_a_bare_at(cue):
    text = f"{cue} alice at example.com today"
    assert pii.masked(text) == f"{cue} <email> today"
    assert pii.masked(f"{cue} us. We meet at example.com") == f"{cue} us. We meet at example.com"


@pytest.mark.parametrize("seed", range(60))
def test_added_spans_are_the_planted_ones(seed):
    """Texts of neutral words with identifiers, plain and disguised, at random places: those are found, in full, and nothing else."""
    r = random.Random(seed)
    words = "harbour stone winter über boats market nobody expected it, however; the old town (rebuilt) and so on - then 你好 \U0001f600".split()
    plain = [("email", "bob.c@mail.example.org"), ("ip", "127.0.0.1"), ("card", "4111 1111 1111 1111"), ("phone", "+49 (170) 555-1234")]
    text, want = "", []
    for _ in range(r.randint(0, 6)):
        text += " ".join(r.choice(words) for _ in range(r.randint(1, 8))) + "; "
        kind, part = r.choice(DISGUISED + plain)
        want.append((kind, len(text), len(text) + len(part)))
        text += part + "; "
    base, every = pii.find(text)  # what the plain patterns find within a disguised one stays beside it
    inside = {(k, a, b) for k, a, b in base if any(k == w[0] and w[1] <= a and b <= w[2] for w in want)}
    assert set(base) == inside and set(every) == {*want, *inside}
