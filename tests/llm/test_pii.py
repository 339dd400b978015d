import hashlib
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerstone.llm import pii
from ledgerstone.llm.pii import KINDS, base_spans, detect, find_spans, normalise, redact, redact_column


def _luhn(d):
    t = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        t += v - 9 if v > 9 else v
    return t % 10 == 0


def plain(text):
    """The contract's patterns, word for word."""
    digits = lambda s: re.sub(r"[^0-9]", "", s)
    return {
        "email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)],
        "ip": [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))],
        "card": [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m[0])) <= 19 and _luhn(digits(m[0]))],
        "phone": [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15],
    }


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(["a", "b_c", "@", ".", "-", "+", "1", "23", "255", "256", "4111111111111111", " ", "(", ")", "x@y.z", "1.2.3.4", "é", "\n", "٣", "%"]), max_size=40))
def test_base_equals_plain_patterns(parts):
    text = "".join(parts)
    assert base_spans(text) == plain(text)


@pytest.mark.parametrize(
    "text, kind, found",
    [
        ("write jane [at] mail (dot) example [dot] com now", "email", "jane [at] mail (dot) example [dot] com"),
        ("write jane at mail dot example dot com", "email", "jane at mail dot example dot com"),
        ("é jаne＠mail．example．com é", "email", "jаne＠mail．example．com"),
        ("call +one two three four five six seven eight nine five, ok", "phone", "+one two three four five six seven eight nine five"),
        ("at １９２．１６８．０．１ there", "ip", "１９２．１６８．０．１"),
        ("card four one one one 1111 1111 one one one one", "card", "four one one one 1111 1111 one one one one"),
    ],
)
def test_disguises_map_back_to_the_source(text, kind, found):
    base, every = find_spans(text)
    assert base[kind] == []
    assert [text[a:b] for a, b in every[kind]] == [found]


def test_base_spans_stay_and_clean_text_is_left_alone():
    text = "a@b.co and jane [at] mail dot com, meet at the dot one two"
    base, every = find_spans(text)
    assert set(base["email"]) <= set(every["email"])
    for clean in ("look at the dot there", "one two three", "we met at noon", "", "élan où"):
        assert not any(find_spans(clean)[1].values())
    assert normalise("plain") is None
    assert redact("x a@b.co y") == "x [EMAIL] y"


@pytest.mark.parametrize(
    "text",
    ["a [at] b [dot] de" + " " * 2_000_000 + "x", "one two " * 150_000 + "x", "one " + "1 " * 500_000 + "twox", "x at " + "c dot " * 200_000 + "1", "[at" + " " * 1_000_000 + "]", "a@" * 500_000, "0" * 1_000_000 + "1.1.1.1"],
)
def test_disguises_are_undone_in_linear_time(text):
    began = time.perf_counter()
    pii.find_spans(text)
    assert time.perf_counter() - began < 30


def test_chains_of_any_length_and_ending():
    for t in ("bob at mail dot xyz", "sue at mail dot pl", "jane [at] mail dot com", "a at b dot c dot d dot e dot f dot g dot h dot i dot j dot k dot l dot de", "x" * 100 + " at " + "y" * 90 + " dot net"):
        assert pii.find_spans(t)[1]["email"] == [(0, len(t))], t
    assert pii.base_spans("0" * 4001 + "1.1.1.1 5.6.7.8")["ip"] == [(0, 4008), (4009, 4016)]


def test_long_texts_are_linear():
    text = "a" * 300_000 + " " + "1" * 300_000 + ".x " + "a@" * 50_000
    assert sum(map(len, base_spans(text).values())) == 0


def test_column(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a@b.co +1 (017) 555-7713"), (3, "a@b.co +1 (017) 555-7713")], "doc_id long, text string")
    rows = df.select("doc_id", detect(df.text).alias("p"), redact_column(df.text).alias("r")).orderBy("doc_id").collect()
    assert rows[0].p.base_sha256 == rows[1].p.base_sha256 == hashlib.sha256(b"").hexdigest()
    assert rows[0].r is None and rows[2].r == "[EMAIL] [PHONE]" and rows[2].p == rows[3].p
    assert rows[2].p.spans == "email:0:6,phone:7:24" and tuple(rows[2].p)[:4] == (1, 0, 0, 1)
    assert set(KINDS) == {"email", "ip", "card", "phone"}
    assert df.limit(0).select(detect(df.text)).collect() == []


@pytest.mark.parametrize(
    "text, kind, base_found, whole",
    [
        ("write аlice@example.com now", "email", "lice@example.com", "аlice@example.com"),
        ("call +49 30 1234567 ８９ now", "phone", "+49 30 1234567", "+49 30 1234567 ８９"),
    ],
)
def test_a_disguise_around_a_base_span_is_found_whole(text, kind, base_found, whole):
    base, every = find_spans(text)
    assert [text[a:b] for a, b in base[kind]] == [base_found]
    assert {text[a:b] for a, b in every[kind]} == {base_found, whole}
    assert redact(text) == text.replace(whole, f"[{kind.upper()}]")


@pytest.mark.parametrize(
    "found",
    ["jane@mail dot com", "jane [at] mail dot com", "jane at mail dot nl", "jane at mail dot example dot it", "jane [at] mail dot museum", "jane at mail [dot] ch", "j" * 80 + " at mail dot com", "jane at " + "a dot " * 12 + "com", "jane at " + "m" * 90 + " dot ca"],
)
def test_spoken_dots(found):
    text = f"write {found}, please"
    base, every = find_spans(text)
    assert base["email"] == [] and [text[a:b] for a, b in every["email"]] == [found]


def test_spoken_dots_leave_other_text_alone():
    for clean in ("meet me at amazon.com", "look at the dot there", "the dot at noon", "me at amazon.com and one dot here"):
        assert not find_spans(clean)[1]["email"]
    long = "a at " * 50_000 + "a dot " * 50_000 + "@" + "a dot " * 50_000 + "b" * 200_000 + " at" + " " * 100_000
    assert isinstance(find_spans(long)[1]["email"], list)


def test_leading_zeros_of_any_length():
    text = "at " + "0" * 5000 + "10.0.0.1 here"
    assert base_spans(text)["ip"] == [(3, len(text) - 5)] and base_spans("0" * 5000 + "256.0.0.1")["ip"] == []
