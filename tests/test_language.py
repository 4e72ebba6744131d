import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.errors import IrError, ParseError
from quern.plans import request as rq
from quern.plans.codec import decode, encode
from quern.plans.parser import parse, render


def test_all_stages():
    got = parse("\n from social \n\n| where age >= 3\n| where name not in ('a', 'b')\n| navigate knows as k\n| emit { name, k.name , name}\n| limit 7\n")
    assert got == rq.Emit("social", ("name", "k.name", "name"), (rq.Predicate("age", "gte", 3), rq.Predicate("name", "not_in", values=("a", "b"))), 7, rq.Navigate("knows", "k"))


@pytest.mark.parametrize(
    "source, kind",
    [
        ("", "EmptyRequest"), ("  \n", "EmptyRequest"), ("emit { a }", "ExpectedFrom"), ("from 1a\n| emit { a }", "InvalidIdentifier"), ("from a", "ExpectedEmit"),
        ("from a\n| emit { }", "ExpectedField"), ("from a\n| emit { a, }", "ExpectedField"), ("from a\n| emit { a b }", "InvalidIdentifier"), ("from a\n| emit { a", "ExpectedEmit"),
        ("from a\n| where id\n| emit { id }", "ExpectedOperator"), ("from a\n| where id =\n| emit { id }", "ExpectedLiteral"), ("from a\n| where id = active\n| emit { id }", "InvalidLiteral"),
        ("from a\n| where id in ()\n| emit { id }", "ExpectedLiteral"), ("from a\n| where id like x\n| emit { id }", "InvalidLiteral"), ("from a\n| where 1 = id\n| emit { id }", "InvalidIdentifier"),
        ("from a\n| emit { id }\n| limit -1", "InvalidLimit"), ("from a\n| emit { id }\n| limit 4294967296", "InvalidLimit"), ("from a\n| emit { id }\n| where id = 1", "UnsupportedStage"),
        ("from a\n| group by id\n| emit { id }", "UnsupportedStage"), ("from a\n| navigate b\n| emit { id }", "ExpectedAlias"),
        ("from a\n| navigate b as c\n| navigate d as e\n| emit { id }", "UnsupportedStage"), ("from a\n| where id = 99999999999999999999\n| emit { id }", "InvalidLiteral"),
    ],
)
def test_rejected_sources(source, kind):
    with pytest.raises(ParseError) as e:
        parse(source)
    assert e.value.kind == kind and e.value.code == "RF1001"


@pytest.mark.parametrize(
    "request_, kind",
    [
        (rq.Emit("a", ()), "ExpectedField"),
        (rq.Emit("a", ("x",), (rq.Predicate("x", "in", values=(1, "a")),)), "InvalidLiteral"),
        (rq.Emit("a", ("x",), (rq.Predicate("x", "like", 1),)), "InvalidLiteral"),
        (rq.Emit("a", ("x",), (rq.Predicate("x", "is_null", 1),)), "InvalidOperation"),
        (rq.PutKv("kv", "", 1), "ExpectedField"),
        (rq.PutKv("kv", "k", [1.0]), "UnsupportedValue"),
        (rq.Observe(1, "o", 7, "a/b", "Z", "o"), "InvalidModality"),
        (rq.AddEdge("g", "a", "no label", "b"), "InvalidIdentifier"),
        (rq.InsertDocument("d", "1", (("a..b", 1),)), "InvalidIdentifier"),
    ],
)
def test_rejected_requests(request_, kind):
    with pytest.raises(IrError) as e:
        rq.validate(request_)
    assert e.value.kind == kind and e.value.code == "RF1003"


ALL = [
    parse("from t\n| where a = -1\n| where b like 'x%'\n| where c is not null\n| where d in (true, false)\n| emit { a }\n| limit 0"),
    parse("from g\n| navigate e as x\n| emit { x.a }"), rq.Observe(9, "o", 1, "a/b", "2026Z", "here"), rq.ReadPayload(3),
    rq.InsertDocument("d", "1", (("a.b", 1), ("c", None), ("e", "ü"), ("f", True))), rq.AddNode("g", "n"), rq.AddEdge("g", "a", "l", "b"), rq.PutKv("k", "a", "b"),
]


@pytest.mark.parametrize("request_", ALL, ids=lambda r: type(r).__name__)
def test_bytes_round_trip_and_every_cut_is_rejected(request_):
    raw = encode(request_)
    assert decode(raw) == request_ and encode(decode(raw)) == raw
    for n in range(len(raw)):
        with pytest.raises(IrError):
            decode(raw[:n])
    with pytest.raises(IrError):
        decode(raw + b"\0")


def test_byte_layout():
    assert encode(rq.Emit("t", ("a",))).hex() == "0006" + "00" * 8 + "01" + "000174" + "00" + "0001" + "000161" + "00" + "00"
    with pytest.raises(IrError) as e:
        decode(b"\0\5" + encode(rq.Emit("t", ("a",)))[2:])
    assert e.value.code == "RF1004"


names = st.from_regex(r"\A[a-z_][a-z0-9_]{0,5}\Z")
texts = st.text(st.characters(blacklist_characters="\n\r,", blacklist_categories=["Cs"]), max_size=8)
literals = st.one_of(st.integers(-(2**63), 2**63 - 1), texts, st.booleans())
predicates = st.one_of(
    st.builds(rq.Predicate, names, st.sampled_from(rq.COMPARISONS), literals), st.builds(rq.Predicate, names, st.sampled_from(["is_null", "not_null"])),
    st.builds(rq.Predicate, names, st.sampled_from(["like", "not_like"]), texts),
    st.builds(lambda p, o, v: rq.Predicate(p, o, values=tuple(v)), names, st.sampled_from(["in", "not_in"]), st.one_of(st.lists(st.integers(-9, 9), min_size=1, max_size=3), st.lists(texts, min_size=1, max_size=3))),
)
requests = st.builds(lambda s, f, w, n, g: rq.Emit(s, tuple(f), tuple(w), n, g), names, st.lists(names, min_size=1, max_size=3), st.lists(predicates, max_size=3), st.none() | st.integers(0, 2**32 - 1), st.none() | st.builds(rq.Navigate, names, names))


@settings(max_examples=150, deadline=None)
@given(requests)
def test_text_and_bytes_say_the_same(request_):
    assert decode(encode(request_)) == request_
    assert parse(render(request_)) == request_
