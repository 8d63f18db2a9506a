"""Seeds are whole base spans, and contexts come from the whole text."""

from common_cases import collected, frame
from sievemark.llm import op6_pii
from test_reports import luhn


def test_spans_with_spaces_and_contexts_past_digits(spark):
    cards = [c for c in (f"41111111{i:08d}" for i in range(100)) if luhn(c)][:10]
    spaced = [" ".join(c[k:k + 4] for k in range(0, 16, 4)) for c in cards]
    docs = [(i, f"pay with card number {c} today") for i, c in enumerate(spaced)]
    docs += [(20, "pay with card number 4111 1111 1111 1112, today"), (21, "serial 4111 1111 1111 1112 is here")]
    docs += [(30 + i, f"wallet no12345x {c} (end)") for i, c in enumerate(cards)]  # the word before holds digits
    docs += [(50, "wallet no98765x 4111111111111112 (end)"), (51, "wallet none 4111111111111112 (end)")]
    spans = {r["doc_id"]: r["spans"] for r in collected(op6_pii.personal_data(frame(spark, docs)))}
    assert spans[0] == "card:21:40" and spans[20] == "card:21:40" and spans[21] == ""
    assert spans[50] == "card:16:32" and spans[51] == ""


def test_phones_and_mails_make_patterns(spark):
    """Phones with brackets and mails without digits are seeds with the words before them."""
    docs = [(i, f"my phone is +1 (017) 555-{7000 + i} now, write to mail {'abcdefgh'[i]}x@host.example soon") for i in range(8)]
    pieces = op6_pii.found_pieces(op6_pii.keyed(frame(spark, docs), "doc_id", "text")).where("kind IN ('phone', 'email')")
    made = pieces.select("kind", op6_pii._patterns(pieces["left"], pieces["right"]).alias("p")).collect()
    assert {(r["kind"], x) for r in made for x in r["p"]} == {
        ("phone", "phone is _"), ("phone", "is _ now"), ("phone", "is _"), ("email", "to mail _"), ("email", "mail _ soon"), ("email", "mail _")}
    base, _ = op6_pii.pii_spans(frame(spark, docs))
    assert base.count() == 16


UNSEEN = {
    "phone": ["017 555 7713", "(017) 555-7714", "017.555.7715", "0175557716"],
    "card": ["4111 1111 1111 1", "4111111111111", "4111-1111-1111-1112"],
    "email": ["someone (at) host.example", "other[at]host.example.org", "nobody@localhost"],
    "ip": ["10.20.30.999", "fe80:0:0:0:12:34:56:78"],
}


def test_unseen_identifiers_are_found_in_learned_contexts_only(spark):
    cards = [c for c in (f"41111111{i:08d}" for i in range(600)) if luhn(c)][:40]
    docs = [(i, f"She said: my phone is +1 (017) 555-{7000 + i} now. Write to mail a{i}x@host.example soon, pay by card number {cards[i]} today, the server has address 10.0.{i}.7 there.") for i in range(40)]
    frames = {"phone": "my phone is {} now", "card": "pay by card number {} today", "email": "write to mail {} soon", "ip": "server has address {} there"}
    planted, n = {}, 100
    for kind, found in UNSEEN.items():
        for x in found:
            planted[n] = (kind, x, frames[kind].format(x))
            planted[n + 1] = (None, x, f"about the part {x} nothing is known")
            n += 2
    odd = [(500, "my phone is room12 now"), (501, "write to mail 12345 soon"), (502, "pay by card number 77777 today"), (503, "server has address 4a there"), (504, "w" * 3000 + " phone is 017 555 7799 now")]
    rows = docs + [(i, t) for i, (_, _, t) in planted.items()] + odd
    spans = {r["doc_id"]: r["spans"] for r in collected(op6_pii.personal_data(frame(spark, rows)))}
    caught = 0
    for i, (kind, x, text) in planted.items():
        start = text.index(x)
        if kind is None:
            assert spans[i] == "", (x, spans[i])
        else:
            caught += spans[i] == f"{kind}:{start}:{start + len(x)}"
            assert spans[i] in ("", f"{kind}:{start}:{start + len(x)}"), (x, spans[i])
    assert caught == sum(map(len, UNSEEN.values()))
    assert [spans[i] for i, _ in odd[:4]] == [""] * 4
    assert spans[504] == f"phone:{3000 + 10}:{3000 + 22}"
