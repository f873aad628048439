import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from custaris.llm import pii


def brute(text):
    """The base patterns as written, by plain regular expressions."""
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"[^0-9]", "", m.group())
        if 14 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
            if 10 <= len(re.sub(r"[^0-9]", "", m.group())) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="a.@1290+-( )é", max_size=50))
def test_base_spans(text):
    assert pii.order(pii.base_spans(text)) == brute(text)


def test_literals():
    t = "x a.b@c.de 1.2.3.4 999.1.1.1 card 4111 1111 1111 1111 tel +1 (017) 555-7713 @ a@b c@d.e@f.g"
    got = pii.order(pii.base_spans(t))
    assert got == brute(t)
    assert [k for k, _, _ in got] == ["email", "ip", "card", "phone", "email"]
    assert len(pii.base_spans("1" * 5000 + "." + "0" * 5000 + "1.1.1")) == 0


def test_query_whole_table(spark, sample):
    got = {r.doc_id: r for r in pii.op9_pii(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(sample)
    for i, t in zip(sample.doc_id, sample.text):
        want = brute(t)
        assert got[i].base_sha256 == hashlib.sha256(pii.spell(want).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(x[0] == k for x in want) for k in pii.KINDS]
        spans = [s for s in got[i].spans.split(",") if s]
        assert {f"{k}:{a}:{e}" for k, a, e in want} <= set(spans)


def test_method_finds_disguised_and_leaves_numbers(spark, docs_of):
    rows, n = [], 0
    for k in range(120):
        rows.append((n, f"write to user{k}.x@mail{k}.example.com or call +1 ({100 + k}) 555-{1000 + 7 * k} now, item {k * 977} of 12-{k:02d}-2020", "en", "s", 1))
        n += 1
    rows.append((1000, "please call (212) 555-0142 today or write someone at mail3 dot example dot com", "en", "s", 1))
    rows.append((1001, "the year 1999 and 20,000 people, page 12 of 300", "en", "s", 1))
    out = {r.doc_id: r for r in pii.scan(docs_of(rows), pii.fit(docs_of(rows)), keep=["doc_id"]).collect()}
    assert out[1001].spans == ""
    assert out[0].n_email == 1 and out[0].n_phone == 1
    red = {r.doc_id: r.text for r in pii.redact(docs_of(rows)).collect()}
    assert "<EMAIL>" in red[0] and "<PHONE>" in red[0] and "@" not in red[0]
    assert red[1001] == rows[-1][1]


def test_nulls_repeats_and_empty(spark, docs_of):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "a@b.c", "en", "s", 5), (1, "a@b.c", "en", "s", 5)]
    out = pii.scan(docs_of(rows), {}, keep=["doc_id"]).collect()
    assert sorted(r.spans for r in out) == ["", "", "email:0:5", "email:0:5"]
    assert pii.scan(docs_of([]), pii.fit(docs_of([])), keep=["doc_id"]).count() == 0
    assert sorted(str(r.text) for r in pii.redact(docs_of(rows)).collect()) == ["", "<EMAIL>", "<EMAIL>", "None"]


def test_long_runs_of_digits_stay_linear():
    t = "7" * 400_000 + " 1.2.3.4." + "5" * 400_000
    assert ("ip", 400_001, 400_008) in pii.base_spans(t)
